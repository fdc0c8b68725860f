"""Shared folder, staged tables and Arrow text helpers of the operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder that the cluster names.

    The folder is read from ``spark.checkpoint.dir``. Only where that is unset and
    driver and tasks are one process on one machine, a temporary folder is made and
    set; on a cluster an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stage(df: DataFrame, where: str, *partition_by: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: a short lineage."""
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def remove(spark: SparkSession, *folders: str) -> None:
    """Delete staged tables that no later step reads."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for f in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)


def finished(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written as a table of its own; the working folder that it was made from goes."""
    out = stage(df, shared_dir(df.sparkSession))
    remove(df.sparkSession, folder)
    return out


#: A key is hot when it holds more than one in HOT rows, and more than FEW: no data has more than HOT hot keys.
HOT, FEW = 1000, 1000


def by_key(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """``rows`` joined with a ``table`` that has one row a key, whatever share of the rows a key holds.

    Hot keys number ``HOT`` at most; their rows of the table are broadcast, so rows of
    one key stay spread over tasks. All other rows are joined by a shuffle. ``rows``
    is read several times: it should be a written table. hot: the hot keys, if known.
    """
    hot = hot_keys(rows, key) if hot is None else hot
    if not hot:
        return rows.join(table, key, how)
    few = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in hot], rows.select(key).schema))
    apart = rows.join(few, key, "left_semi").join(F.broadcast(table.join(few, key, "left_semi")), key, how)
    return rows.join(few, key, "left_anti").join(table, key, how).unionByName(apart)


def hot_keys(rows: DataFrame, key: str) -> list:
    """The keys of more than one in ``HOT`` rows, ``HOT`` at most."""
    n = rows.groupBy(key).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > FEW)
    return [r[0] for r in n.filter(F.col("n_rows") * HOT > rows.count()).select(key).collect()]


def tasks(df: DataFrame) -> int:
    """Partitions for work that must keep all cores busy."""
    s = df.sparkSession
    return max(int(s.conf.get("spark.sql.shuffle.partitions")), s.sparkContext.defaultParallelism)


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges of at most ``most`` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


#: Row numbers (16 bytes each) that ``without`` broadcasts; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written once with a number for each row, and that column's name."""
    row = "row_no"
    while row in (c.lower() for c in docs.columns):
        row += "_"
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), f"{shared_dir(docs.sparkSession)}/numbered"), row


def without(docs: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """Numbered ``docs`` less the rows in ``gone`` (a column ``gone`` of row numbers), without the numbers.

    Numbers, unlike ids, are never null and never repeat; an empty ``gone`` leaves all rows.
    """
    gone = stage(gone, f"{shared_dir(docs.sparkSession)}/gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[row] == gone["gone"], "left_anti").drop(row)
