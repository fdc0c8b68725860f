"""Matching artwork files to records, and reuse of readings by content."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import shared_dir, staged
from .components import components


def by_declared_name(records: DataFrame, files: DataFrame) -> DataFrame:
    """(cola_id, file_no): the file that a record declares, in any case.

    Of equal names the first file goes to the first record, the second to the second,
    and so on. A record with several names declares the least one that a file has.
    """
    nth = lambda order: F.row_number().over(Window.partitionBy("name").orderBy(order))
    have = files.select("file_no", F.lower("file_name").alias("name"))
    known = records.select("cola_id", F.lower("image").alias("name")).join(have, "name", "left_semi")
    want = known.groupBy("cola_id").agg(F.min("name").alias("name"))
    return want.withColumn("nth", nth("cola_id")).join(have.withColumn("nth", nth("file_no")), ["name", "nth"]).select("cola_id", "file_no")


def ids_in_names(records: DataFrame, files: DataFrame) -> DataFrame:
    """(file_no, cola_id, size): every id inside a file name, in any case, and its length.

    Instead of testing every pair, each file name gives its substrings of the
    lengths that ids have, and those meet the ids in an equi-join.
    """
    ids = records.select("cola_id", F.lower("cola_id").alias("key")).distinct()
    lengths = sorted(r[0] for r in ids.select(F.length("key")).distinct().collect() if r[0])  # a handful
    if not lengths:
        return ids.join(files, F.lit(False)).select("file_no", "cola_id", F.length("cola_id").alias("size"))
    name = F.lower("file_name")

    def pieces(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substring(name, i, F.lit(n)))
        return F.when(F.length(name) >= n, cut).otherwise(F.array().cast("array<string>"))

    parts = F.flatten(F.array(*(pieces(n) for n in lengths)))
    grams = files.select("file_no", F.explode(F.array_distinct(parts)).alias("key"))
    return grams.join(ids, "key").select("file_no", "cola_id", F.length("key").alias("size"))


#: Steps that settle what is certain, before the rest is walked.
CERTAIN = 3


def walk(wishes: DataFrame, certain: int = CERTAIN) -> DataFrame:
    """(cola_id, file_no, how) when files choose one after the other, each the first free id of its list.

    wishes: file_no, cola_id, how, and ``place`` (any order) in the file's list.
    A file gets its first wish for certain if no file before it lists that id; both
    are then out of everybody's way. A few such steps take ids that very many files hold.
    What is left falls into components that share no id: each is walked in file
    order by one task, which keeps the ids taken in it, no rows. The number of jobs does
    not follow the length of a chain of files that take each other's ids.
    """
    folder = shared_dir(wishes.sparkSession)
    open_ = staged(wishes.filter("file_no IS NOT NULL AND cola_id IS NOT NULL").select(F.col("file_no").cast("bigint").alias("file_no"), "cola_id", "how", "place"), f"{folder}/open0")
    sure = None
    for step in range(1, certain + 1):
        first = open_.groupBy("cola_id").agg(F.min("file_no").alias("first"))
        wish = open_.groupBy("file_no").agg(F.min(F.struct("place", "cola_id", "how")).alias("w")).select("file_no", "w.cola_id", "w.how")
        got = staged(wish.join(first, "cola_id").filter(F.col("file_no") == F.col("first")).select("cola_id", "file_no", "how"), f"{folder}/sure{step}")
        sure = got if sure is None else sure.unionByName(got)
        open_ = staged(open_.join(got.select("file_no"), "file_no", "left_anti").join(got.select("cola_id"), "cola_id", "left_anti"), f"{folder}/open{step}")
    # Files that list an id are tied to the first of them: as many edges as wishes.
    first = open_.groupBy("cola_id").agg(F.min("file_no").alias("b"))
    parts = components(open_.join(first, "cola_id").select(F.col("file_no").alias("a"), "b"))

    def choose(batches):
        part, file, taken, served = None, None, set(), False
        for b in batches:
            rows = []
            for p, f, i, how in zip(*(b.column(c).to_pylist() for c in ("component", "file_no", "cola_id", "how"))):
                if p != part:
                    part, taken = p, set()
                    file = None
                if f != file:
                    file, served = f, False
                if not served and i not in taken:
                    served = True
                    taken.add(i)
                    rows.append((i, f, how))
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], ["cola_id", "file_no", "how"])

    lists = open_.join(parts.withColumnRenamed("node", "file_no"), "file_no").repartition("component").sortWithinPartitions("component", "file_no", "place", "cola_id")
    rest = lists.select("component", "file_no", "cola_id", "how").mapInArrow(choose, "cola_id string, file_no bigint, how string")
    return rest if sure is None else sure.unionByName(rest)


def by_contained_id(records: DataFrame, files: DataFrame, rounds: int | None = None) -> DataFrame:
    """(cola_id, file_no): an id inside the file name, the longest free one, in file order.

    rounds: 1 gives the first claims alone: of each file the longest id, of each id the first such file.
    """
    found = ids_in_names(records, files)
    if rounds == 1:
        claims = found.groupBy("file_no").agg(F.min(F.struct((-F.col("size")).alias("size"), "cola_id")).alias("best"))
        return claims.groupBy(F.col("best.cola_id").alias("cola_id")).agg(F.min("file_no").alias("file_no"))
    return walk(found.select("file_no", "cola_id", F.lit("contained").alias("how"), (-F.col("size")).alias("place"))).select("cola_id", "file_no")


def match(records: DataFrame, files: DataFrame) -> DataFrame:
    """(cola_id, file_no, how): files in order, each the first free record that declares its name, else the longest free id in it.

    Records that declare one name, and ids of one length, go by id. A record may declare several names.
    """
    named = files.select("file_no", F.lower("file_name").alias("name")).join(records.select("cola_id", F.lower("image").alias("name")).distinct(), "name")
    wishes = named.select("file_no", "cola_id", F.lit("declared").alias("how"), F.struct(F.lit(0).alias("kind"), F.lit(0).alias("size")).alias("place"))
    inside = ids_in_names(records, files).select("file_no", "cola_id", F.lit("contained").alias("how"), F.struct(F.lit(1).alias("kind"), (-F.col("size")).alias("size")).alias("place"))
    return walk(wishes.unionByName(inside))


def without_image(records: DataFrame, matches: DataFrame) -> DataFrame:
    return records.join(matches, "cola_id", "left_anti")


def without_record(files: DataFrame, matches: DataFrame) -> DataFrame:
    return files.join(matches, "file_no", "left_anti")


def unmatched_note(records: DataFrame, files: DataFrame, matches: DataFrame, named: int = 5) -> DataFrame:
    """One row: records without an image, images without a record, and the names of the first ``named`` of those."""
    left = without_record(files, matches)
    first = left.orderBy("file_no").limit(named).agg(F.sort_array(F.collect_list(F.struct("file_no", "file_name"))).alias("f"))
    both = left.agg(F.count("*").alias("images")).join(without_image(records.select("cola_id").distinct(), matches).agg(F.count("*").alias("records"))).join(first)  # one row each
    more = F.when(F.col("images") > named, "…").otherwise("")
    return both.select("records", "images", F.concat(F.array_join(F.transform("f", lambda x: x["file_name"]), ", "), more).alias("first_images"))


def to_review(records: DataFrame, matches: DataFrame) -> DataFrame:
    return records.join(matches, "cola_id", "left_semi")


def digested(images: DataFrame, content: str) -> DataFrame:
    return images.withColumn("digest", F.sha2(F.col(content).cast("binary"), 256))


def read_once(requests: DataFrame, extract, content: str) -> DataFrame:
    """Each distinct content goes through ``extract`` once; all its requests get the reading.

    extract: rows (digest, content) to rows with ``digest`` and the reading. Copies
    meet in a partial aggregate before the shuffle; the join back splits a popular
    content by Spark's skew handling.
    """
    keyed = digested(requests, content)
    distinct = keyed.groupBy("digest").agg(F.first(content).alias(content))
    return keyed.drop(content).join(extract(distinct), "digest")


def recorded(requests: DataFrame, readings: DataFrame) -> DataFrame:
    """Readings by digest; a request without one gets an error, not a silent loss."""
    known = readings.withColumn("known", F.lit(True))
    return requests.join(known, "digest", "left").withColumn("error", F.when(F.col("known").isNull(), "no_recorded_reading")).drop("known")
