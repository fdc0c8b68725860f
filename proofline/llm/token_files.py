"""Token ids in flat binary files.

Format, one set of files a partition, below one folder:

``part-N.bin``   ids, little-endian unsigned 16-bit where the vocabulary fits, else
                 32-bit, documents in ascending doc_id order, nothing between them
``part-N.idx``   little-endian signed 64-bit: the doc_ids, then n+1 local offsets in ids
``manifest``     Parquet: part, n_docs, n_tokens, width; the base of a partition is
                 the prefix sum of the sizes before it

The number of files follows the measured bytes of text; rows of one doc_id may lie in several.
Files are named by partition and moved into place when whole, so a task that runs
twice after a lost executor writes the same bytes again. Rows with equal doc_id
are ordered by text; a null doc_id comes first (stored as the lowest 64-bit value).
A null text is empty. An empty table gives no files' rows. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, shared_dir, tasks, texts_of
from .tokens import encoder

NULL_ID = -(2**63)
#: Bytes of text of a file while the corpus has under EVEN bytes, and of the largest file.
PART, EVEN, LARGEST = 64 << 20, 64 << 30, 1 << 30
#: Letters of a text that may part rows of one doc_id.
HEAD = 16
MANIFEST = "part int, n_docs bigint, n_tokens bigint, width int"


def n_parts(total: int, cores: int) -> int:
    """Files for ``total`` bytes of text: they grow with the square root of a large corpus, up to a bound."""
    return max(cores, -(-total // min(int(PART * max(total / EVEN, 1.0) ** 0.5), LARGEST)))


def write_token_files(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> str:
    """Encode every text, append ``end_id`` and write the files; returns the folder."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)

    def write(batches):
        part = TaskContext.get().partitionId()
        enc, fs = None, None
        n_docs = n_tokens = 0
        doc_ids, sizes = [], []
        for b in batches:
            if not b.num_rows:
                continue
            if enc is None:
                enc = encoder(path)
                width = 2 if enc.vocab <= 1 << 16 and end_id < 1 << 16 else 4
                fs, root = pafs.FileSystem.from_uri(folder)
                fs.create_dir(root, recursive=True)
                mine = uuid.uuid4().hex
                out = fs.open_output_stream(f"{root}/.{mine}.bin")
            raw, off = texts_of(b.column(1))
            for lo, hi in chunks(off, 1 << 21):
                ids, at = enc.ids([raw[off[i] : off[i + 1]].tobytes().decode() for i in range(lo, hi)])
                flat = np.insert(ids, at[1:], end_id).astype(f"<u{width}")
                out.write(flat)
                sizes.append(np.diff(at) + 1)
                n_tokens += len(flat)
            doc_ids.append(b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
            n_docs += b.num_rows
        if enc is None:
            return
        out.close()
        index = np.concatenate([*doc_ids, [0], np.cumsum(np.concatenate(sizes))]).astype("<i8")
        with fs.open_output_stream(f"{root}/.{mine}.idx") as f:
            f.write(index)
        for kind in ("bin", "idx"):
            fs.move(f"{root}/.{mine}.{kind}", f"{root}/part-{part:05d}.{kind}")
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64()), pa.array([width], pa.int32())], ["part", "n_docs", "n_tokens", "width"])

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = n_parts(total, spark.sparkContext.defaultParallelism)
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id", F.substring("text", 1, HEAD)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


def bases(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with ``base``, the ids before each partition: a row a partition."""
    parts = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _open(uri: str, dtype: str):
    """read(lo, hi) of a file's numbers: memory-mapped where the folder is mounted, else by ranged reads."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return _mapped(path, dtype) if isinstance(fs, pafs.LocalFileSystem) else _ranged(fs.open_input_file(path), dtype)


def _mapped(path: str, dtype: str):
    numbers = np.memmap(path, dtype, "r")
    return lambda lo, hi: numbers[lo:hi]


def _ranged(f: pa.NativeFile, dtype: str):
    width = np.dtype(dtype).itemsize
    return lambda lo, hi: np.frombuffer(f.read_at((hi - lo) * width, lo * width), dtype)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches):
        for b in batches:
            for part, n_docs, width, base in zip(*(b.column(i).to_pylist() for i in range(4))):
                index = _open(f"{folder}/part-{part:05d}.idx", "<i8")
                ids = _open(f"{folder}/part-{part:05d}.bin", f"<u{width}")
                for first in range(0, n_docs, 10_000):
                    last = min(first + 10_000, n_docs)
                    names, at = np.array(index(first, last)), np.array(index(n_docs + first, n_docs + last + 1))
                    for lo, hi in chunks(at, 1 << 22):
                        flat = ids(at[lo], at[hi]).astype("<u4")
                        cut = (at[lo : hi + 1] - at[lo]).tolist()
                        crc = [zlib.crc32(flat[x:y]) for x, y in zip(cut, cut[1:])]
                        docs = names[lo:hi]
                        yield pa.record_batch([pa.array(docs, mask=docs == NULL_ID), pa.array(at[lo:hi] + base), pa.array(np.diff(at[lo : hi + 1])), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = bases(spark, folder).select("part", "n_docs", "width", "base")
    return parts.repartition(tasks(parts), "part").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
