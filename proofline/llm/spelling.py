"""Grouping of spelling variants through an index of variable-length grams.

Words are counted over all texts; the frequent ones form the dictionary. Its grams
(2 to ``LONGEST`` code points of a word between marks) are counted, and pruned by
frequency: a gram that few words hold is never made longer, so a place of a word has one
gram, the shortest rare one from there on. Whether a gram is taken depends on its own
letters alone, so an edit spoils just the grams that lie over it. The most that one edit
can spoil is a word's bound. Two near words therefore share, in place, one of the
``bound + 1`` rarest grams of either: only those grams' lists are merged. Lists are kept by
(gram, place, length), since an edit moves a gram by one place at most. Each pair that a
list gives is verified by its edit distance.

A list of more than ``LONG_LIST`` words is merged by its words with one letter left
out, which near words share: its rows grow with the list, not with its square. Frequent
grams number ``FREQUENT`` a length at most, since the limit of frequency grows with the
dictionary; they alone are sent to tasks.

Null and empty texts have no words; equal texts count each time; a null doc_id reads as
empty in the digest that alters a run. A text is held whole by one task, with about ten
times its bytes while its runs are counted. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_key, shared_dir, stage

SHORTEST, LONGEST = 2, 6
#: Words of a list that is merged pair by pair; frequent grams of a length; words that make a gram frequent, at least.
LONG_LIST, FREQUENT, FEW = 64, 50_000, 8
#: Distinct words that a task counts before it passes the counts on.
COUNTED = 200_000
LOWER = {i: i + 32 for i in range(65, 91)}


def altered(doc_id: int | None, run: str, one_in: int = 199) -> str:
    """The run as counted: of a few, told by a digest, one letter is missing."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % one_in == 0 else run


def word_counts(docs: DataFrame, letters: int = 6, most: int = COUNTED) -> DataFrame:
    """(word, n) of all words of at least ``letters`` code points."""
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % letters)

    def count(batches):
        total = Counter()

        def out():
            return pa.record_batch([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                for run, n in Counter(runs.findall((text.as_py() or "").translate(LOWER))).items():
                    word = altered(doc, run)
                    if len(word) >= letters:
                        total[word] += n
                if len(total) >= most:
                    yield out()
                    total.clear()
        if total:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def marked(word: Column) -> Column:
    return F.concat(F.lit("^"), word, F.lit("$"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(gram, held) for all grams below the longest: in how many places of the dictionary."""
    m = marked(F.col("word"))
    cut = F.flatten(F.transform(F.sequence(F.lit(1), F.length(m) - 1), lambda p: F.transform(F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST - 1), F.length(m) - p + 1)), lambda q: F.substring(m, p, q))))
    return words.select(F.explode(cut).alias("gram")).groupBy("gram").agg(F.count("*").alias("held"))


def frequent_grams(words: DataFrame, few: int = FEW, most: int = FREQUENT) -> set[str]:
    """Grams that more than a limit of places hold: ``most`` a length at the most, by the limit's choice."""
    places = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    limit = max(few, -(-places // most))
    return {r["gram"] for r in gram_counts(words).filter(F.col("held") > limit).select("gram").collect()}


def grams_of(word: str, frequent: set[str]) -> list[str]:
    """Of each place but the last: the shortest gram that is not frequent, or the longest there is."""
    m = f"^{word}$"
    out = []
    for p in range(len(m) - 1):
        q = SHORTEST
        while q < LONGEST and p + q < len(m) and m[p : p + q] in frequent:
            q += 1
        out.append(m[p : p + q])
    return out


def spoiled_at_most(grams: list[str]) -> int:
    """The most grams that one letter lies in: so many an edit can spoil."""
    step = Counter()
    for p, g in enumerate(grams):
        step[p] += 1
        step[p + len(g)] -= 1
    most = now = 0
    for i in range(1, len(grams)):  # the letters, without the marks
        now = now + step[i] + (step[0] if i == 1 else 0)
        most = max(most, now)
    return most


def gram_places(words: DataFrame, frequent: set[str]) -> DataFrame:
    """(word, size, gram, place, bound): every gram of every word, and the word's bound."""
    own = words.sparkSession.sparkContext.broadcast(frequent)

    def cut(batches):
        for b in batches:
            rows = []
            for w in b.column("word").to_pylist():
                grams = grams_of(w, own.value)
                bound = spoiled_at_most(grams)
                rows += [(w, len(w), g, p, bound) for p, g in enumerate(grams)]
            if rows:
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["word", "size", "gram", "place", "bound"])

    return words.select("word").mapInArrow(cut, "word string, size int, gram string, place int, bound int")


KEY = ["gram", "place", "size"]


def without_letter(place: str = "i") -> Column:
    """The word without its letter number ``place``."""
    return F.concat(F.expr(f"substring(word, 1, {place} - 1)"), F.expr(f"substring(word, {place} + 1)"))


def near_words(words: DataFrame, folder: str, few: int = FEW, long_list: int = LONG_LIST) -> DataFrame:
    """(a, b), once each, with a no longer than b: words that differ by one inserted, deleted or replaced letter.

    words: a written table with a column ``word`` of distinct words of ``LONGEST`` letters or more.
    """
    places = stage(gram_places(words, frequent_grams(words, few)), f"{folder}/places")
    held = places.groupBy("gram").agg(F.count("*").alias("held"))
    ranked = by_key(places, held, "gram").withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy("held", "gram", "place")))
    lists = stage(ranked.filter(F.col("rank") <= F.col("bound") + 1).select("word", *KEY), f"{folder}/lists")
    long = stage(lists.groupBy(*KEY).agg(F.count("*").alias("n")).filter(F.col("n") > long_list).select(*KEY), f"{folder}/long")
    short = lists.join(long, KEY, "left_anti")
    # A pair of one size shares the place; in a word of one letter more the gram is there or one place on.
    moves = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(s).alias("s")) for p, s in ((0, 0), (0, 1), (1, 1))))
    probes = lists.select(F.col("word").alias("a"), "gram", F.col("size").alias("own"), F.col("place").alias("at"), F.explode(moves).alias("m"))
    probes = probes.select("a", "own", "gram", (F.col("at") + F.col("m.p")).alias("place"), (F.col("own") + F.col("m.s")).alias("size"))
    pairs = probes.join(short.withColumnRenamed("word", "b"), KEY).filter((F.col("own") < F.col("size")) | (F.col("a") < F.col("b")))
    near = pairs.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b")
    # Long lists: words of one size meet where one letter is left out, a word and a longer one where that gives the word.
    cut = lists.join(long, KEY, "left_semi").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size")))).withColumn("rest", without_letter())
    same = cut.select(*KEY, "i", "rest", F.col("word").alias("a")).join(cut.select(*KEY, "i", "rest", F.col("word").alias("b")), [*KEY, "i", "rest"]).filter("a < b")
    more = probes.filter("own < size").withColumn("rest", F.col("a")).join(cut.select(*KEY, "rest", F.col("word").alias("b")), [*KEY, "rest"])
    return near.unionByName(same.select("a", "b")).unionByName(more.select("a", "b")).distinct()


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """(word, root): the end of each word's chain of forms, by doubling.

    forms: (word, form), form never null, no circle. A root that many words reach is one hot key.
    """
    now, turn = stage(forms.select("word", F.col("form").alias("root")), f"{folder}/roots0"), 0
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        got = by_key(now, on, "root", "left")
        turn += 1
        got = stage(got.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"{folder}/roots{turn}")
        now = got.select("word", "root")
        if not got.filter("moved").limit(1).count():
            return now


def group_spellings(docs: DataFrame, letters: int = 6, least: int = 5, times: int = 5, few: int = FEW, long_list: int = LONG_LIST) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``letters`` code points that occurs ``least`` times.

    letters: ``LONGEST`` at least, so that every edit leaves a gram of the word whole.
    """
    if letters < LONGEST:
        raise ValueError(f"words must have {LONGEST} letters or more")
    folder = shared_dir(docs.sparkSession)
    words = stage(word_counts(docs, letters).filter(F.col("n") >= least), f"{folder}/words")
    near = stage(near_words(words.select("word"), folder, few, long_list), f"{folder}/near")
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(near.select(F.col("b").alias("word"), F.col("a").alias("other")))
    other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("down"), "other"))
    found = both.join(other, "other").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.join(found, "word", "left").withColumns({"big": -F.col("best.down"), "n_near": F.coalesce("n_near", F.lit(0).cast("bigint"))})
    formed = F.col("big") >= times * F.col("n")
    found = stage(found.select("word", "n", "n_near", F.when(formed, F.col("best.other")).alias("form"), F.when(formed, F.col("big")).alias("form_n")), f"{folder}/found")
    ends = roots(found.filter("form IS NOT NULL").select("word", "form"), folder)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
