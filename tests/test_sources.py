"""Record files, matching, layout and streams."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofline.functions import similarity
from proofline.operators import layout, matching, second_reading
from proofline.operators.components import components
from proofline.schemas import staged
from proofline.operators.running import running
from proofline.sources import records, sinks
from proofline.streaming import jobs


def test_similarity_by_hand():
    assert round(similarity.ratio("old tom distillery", "old tim distillery"), 2) == 94.44
    assert similarity.ratio("", "") == 100.0
    assert similarity.window_ratio("stillery", "old tom distillery") == 100.0
    assert similarity.sorted_ratio("b a", "a b") == 100.0
    assert similarity.set_ratio("bardstown kentucky", "bardstown") == 100.0 and similarity.set_ratio("", "a") == 0.0
    assert similarity.edits("birth", "bnth") == 2


def test_record_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("COLA ID;Brand;ABV\n1;Château;40,5\n1;Again;40\n2;;40\n;No;40\n3;Strong;450\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes("id,brand,address\n7,Oak,\"Bardstown, Kentucky\"\n".encode("utf-16"))
    (tmp_path / "c.json").write_text('{"records": [{"TTB ID": 9, "brand": "Elm"}, 5, {"id": "10", "brand": "Fir", "abv": "nan"}]}')
    (tmp_path / "d.json").write_text("{oops")
    (tmp_path / "e.csv").write_text(" \n")
    rows = records.checked(records.read_files(spark, str(tmp_path)))
    good, bad = records.first_valid(rows)
    found = {r.cola_id: r for r in good.collect()}
    assert set(found) == {"1", "7", "9"}
    assert found["1"].brand_name == "Château" and found["1"].alcohol_content_pct == 40.5 and found["1"].row_no == 2
    assert found["7"].bottler_address == "Bardstown, Kentucky" and found["9"].row_no == 1
    errors = sorted((r.source_file[-6:-4].strip("/").split(".")[0], r.error) for r in bad.collect())
    assert sorted(e for _, e in errors) == ["bad_json", "bad_percent", "bad_percent", "duplicate_id", "empty", "no_brand", "no_id"]


def test_observations_from_json(spark):
    raw = '{"brand_name": " A ", "class_type": "", "warning_prefix_is_bold": "yes", "warning_text": "W", "field_confidence": {"x": 5, "y": "no"}, "unread_text": ["TL", " "], "field_boxes": {"b": [[0.1, 0.2], [0.3, 0.2], [0.3, 0.4], [0.1, 0.4]], "bad": [[2, 0]]}}'
    r = records.observations(spark.createDataFrame([("1", raw), ("2", "{}")], "cola_id string, raw string")).orderBy("cola_id").collect()
    assert r[0].brand_name == "A" and r[0].class_type is None and r[0].warning_prefix_is_bold is None and r[0].warning_legibility == "read"
    assert r[0].field_confidence == {"x": 5.0} and r[0].unread_text == ["TL"] and list(r[0].field_boxes) == ["b"]
    assert r[1].warning_legibility == "absent" and r[1].image_soft is False


def test_matching_prefers_longest_id(spark):
    recs = spark.createDataFrame([("24-001", None), ("24-0010", None), ("24-9", "Photo.PNG")], "cola_id string, image string")
    files = spark.createDataFrame([(1, "label_24-0010.png"), (2, "x 24-0010 24-001.png"), (3, "photo.png"), (4, "none.png")], "file_no bigint, file_name string")
    m = matching.match(recs, files)
    assert {(r.cola_id, r.file_no, r.how) for r in m.collect()} == {("24-9", 3, "declared"), ("24-0010", 1, "contained"), ("24-001", 2, "contained")}
    assert [r.file_no for r in matching.without_record(files, m).collect()] == [4]
    assert matching.without_image(recs, m).count() == 0 and matching.to_review(recs, m).count() == 3


def _one_by_one(ids, files):
    """The reference's walk: files in order, each takes the longest free id in its name."""
    taken = {}
    for no, name in sorted(files):
        for i in sorted(ids, key=lambda i: (-len(i), i)):
            if i.lower() in name.lower() and i not in taken:
                taken[i] = no
                break
    return taken


def _tables(spark, recs, files):
    return spark.createDataFrame(recs, "cola_id string, image string"), spark.createDataFrame(files, "file_no bigint, file_name string")


def test_losers_of_an_id_go_on_to_the_last_free_one(spark):
    ids = [c * n for n, c in enumerate("abcdef", 1)]
    files = [(i, " ".join(ids)) for i in range(8)]
    got = matching.match(*_tables(spark, [(i, None) for i in ids], files)).collect()
    assert sorted((r.file_no, r.cola_id) for r in got) == [(k, ids[5 - k]) for k in range(6)]


def test_contained_ids_equal_the_walk_in_file_order(spark):
    import random

    r = random.Random(4)
    ids = sorted({"".join(r.choice("ab1") for _ in range(r.randrange(1, 5))) for _ in range(40)})
    files = [(i, "".join(r.choice("AB1-") for _ in range(r.randrange(1, 9)))) for i in range(70)]
    got = matching.by_contained_id(*_tables(spark, [(i, None) for i in ids], files)).collect()
    assert {x.cola_id: x.file_no for x in got} == _one_by_one(ids, files) and len(got) == len({x.file_no for x in got})


def _walk_brute(records, files):
    """The reference's walk: files in order, each the first free record that declares it, else the longest free id inside."""
    taken = {}
    for no, name in sorted(files):
        wishes = [(i, "declared") for i, image in sorted(records) if image and image.lower() == name.lower()]
        wishes += [(i, "contained") for i in sorted({i for i, _ in records}, key=lambda i: (-len(i), i)) if i.lower() in name.lower()]
        for i, how in wishes:
            if i not in taken:
                taken[i] = (no, how)
                break
    return taken


def test_a_declared_name_waits_for_its_file(spark):
    got = matching.match(*_tables(spark, [("12", "b-12.png"), ("1", None)], [(1, "a-12.png"), (2, "b-12.png")])).collect()
    assert {r.cola_id: (r.file_no, r.how) for r in got} == {"12": (1, "contained"), "1": (2, "contained")}


def test_matching_equals_the_walk(spark):
    import random

    for seed in range(3):
        r = random.Random(seed)
        ids = sorted({"".join(r.choice("ab1") for _ in range(r.randrange(1, 5))) for _ in range(40)})
        files = [(i, "".join(r.choice("AB1-") for _ in range(r.randrange(1, 9)))) for i in range(90)]
        records = [(i, r.choice(files)[1].swapcase() if r.random() < 0.5 else None) for i in ids]
        want = _walk_brute(records, files)
        wishes = _tables(spark, records, files)
        got = matching.match(*wishes).collect()
        assert {x.cola_id: (x.file_no, x.how) for x in got} == want and len(got) == len(want)


def test_a_long_chain_takes_as_many_steps_as_a_short_one(spark, monkeypatch):
    """Each file loses its wish to the one before it: n files, but no n jobs."""
    steps = []
    monkeypatch.setattr(matching, "staged", lambda df, where: steps.append(where) or staged(df, where))
    n = 400
    chain = [(k, f"i{j:04}", "contained", p) for k in range(n) for p, j in enumerate((k, k + 1) if k else (1, 0))]
    got = matching.walk(spark.createDataFrame(chain, "file_no bigint, cola_id string, how string, place int")).collect()
    taken, want = set(), {}
    for k in range(n):
        own = next((i for f, i, _, _ in chain if f == k and i not in taken), None)
        taken.add(own)
        want[own] = k
    assert {r.cola_id: r.file_no for r in got} == want and len(steps) == 2 * matching.CERTAIN + 1


def test_components_of_paths_stars_and_pairs(spark):
    r = __import__("random").Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 500)] + [(5000 + 2 * i, 5001 + 2 * i) for i in range(40)] + [(7, 7), (None, 3), (9000, 9000)]
    r.shuffle(edges)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(500)} | {5000 + i: 5000 + i // 2 * 2 for i in range(80)} | {9000: 9000}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_equal_declared_names_pair_in_order(spark):
    recs, files = _tables(spark, [("r1", "a.png"), ("r2", "A.png"), ("r3", "b.png")], [(1, "A.PNG"), (2, "a.png"), (3, "a.png"), (4, "B.png"), (5, "b.png")])
    assert sorted(map(tuple, matching.by_declared_name(recs, files).collect())) == [("r1", 1), ("r2", 2), ("r3", 4)]


def test_registered_id_search_equals_the_walk(spark):
    from proofline.plans import queries

    recs, files = queries._images(spark, "/root/testdata/sf0.01")
    want = _one_by_one(sorted({r.cola_id for r in recs.collect()}), [(f.file_no, f.file_name) for f in files.collect()])
    got = queries.QUERIES["match_contained_all"](spark, "/root/testdata/sf0.01").collect()
    assert {r.cola_id: r.file_no for r in got} == want and len(got) == len(want)


def _line(image, n, text, top, height, conf=95.0):
    return [(image, 1, 1, n, w, 40 * i, top, 35, height, conf) for i, w in enumerate(text.split())]


def test_layout_of_a_label(spark):
    statement = ["GOVERNMENT WARNING: (1) According to the Surgeon General, women should not drink alcoholic", "beverages during pregnancy because of the risk of birth defects. (2) Consumption impairs", "your ability to drive a car or operate machinery, and may cause health problems."]
    words = _line("a", 1, "OLD TOM", 10, 60) + _line("a", 2, "Straight Bourbon Whiskey", 90, 30) + _line("a", 3, "45% Alc./Vol. (90 Proof)", 160, 20) + _line("a", 5, "Bottled by Old Tom Co., Bardstown, Kentucky", 260, 20)
    words += [("a", 1, 1, 4, "750", 0, 210, 35, 20, 96.0), ("a", 1, 1, 4, "mL", 40, 210, 35, 20, 3.0)]
    for i, s in enumerate(statement):
        words += _line("a", 6 + i, s, 400 + 20 * i, 14)
    words += _line("a", 9, "www.example.com", 470, 14)
    df = spark.createDataFrame(words, records.WORDS)
    pages = spark.createDataFrame([("a", 600, 80.0), ("none", 600, 80.0)], "image_id string, image_height int, sharpness double")
    got = {r.image_id: r for r in layout.observations(df, pages).collect()}
    a = got["a"]
    assert (a.brand_name, a.class_type, a.alcohol_statement, a.net_contents) == ("OLD TOM", "Straight Bourbon Whiskey", "45% Alc./Vol. (90 Proof)", "750 mL")
    assert (a.bottler_name, a.bottler_address) == ("Bottled by Old Tom Co.", "Bardstown, Kentucky")
    assert a.warning_text.startswith("GOVERNMENT WARNING: (1)") and a.warning_text.endswith("health problems.") and a.warning_legibility == "read"
    assert not a.degraded and got["none"].words_read == 0 and got["none"].error == "no_words"


def test_box_in_fractions(spark):
    df = spark.range(1).select(layout.to_fractions(F.struct(F.lit(50.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(150.0).alias("x1"), F.lit(500.0).alias("y1")), F.lit(1.0), F.lit(0.0), F.lit(200), F.lit(400)).alias("q"))
    assert df.first().q == [[0.25, 0.05], [0.75, 0.05], [0.75, 1.0], [0.25, 1.0]]


def test_token_bucket_and_stream_agree(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    log = [("a", i, t0 + dt.timedelta(seconds=s), 1.0) for i, s in enumerate((0, 0, 0, 30, 61, 61))] + [("b", 10, t0, 5.0)]
    df = spark.createDataFrame(log, "client string, request_id bigint, ts timestamp, cost double")
    got = {r.request_id: r.wait_s for r in jobs.admissions(df, per_minute=2, burst=2).collect()}
    assert [got[i] for i in range(6)] == [0.0, 0.0, 30.0, 0.0, 0.0, got[5]] and got[5] > 0 and got[10] == 90.0
    end = spark.createDataFrame([("end", 99, t0 + dt.timedelta(days=1), 1.0)], df.schema)  # the watermark passes what came before
    assert _admitted(spark, tmp_path / "one", [df, end], per_minute=2, burst=2) == got


def _admitted(spark, folder, files, late="1 minute", **bucket):
    """Waits by request of a stream that gets one file a batch; without the last file's, which nothing passes."""
    for k, f in enumerate(files):
        f.coalesce(1).write.mode("append").parquet(str(folder / "in"))
        newest = max((folder / "in").glob("part-*.parquet"), key=lambda p: p.stat().st_mtime_ns)
        __import__("os").utime(newest, (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema(files[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        done = jobs.admission_stream(stream, late=late, **bucket)
        q = done.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(240)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return {r.request_id: r.wait_s for r in spark.read.parquet(str(folder / "out")).collect()}


def test_requests_in_any_order_are_admitted_as_in_order(spark, tmp_path):
    """Shuffled within the bound, over several batches, with equal times and an idle hour."""
    import random

    r, t0 = random.Random(2), dt.datetime(2024, 1, 1)
    log = [(r.choice("ab"), i, t0 + dt.timedelta(seconds=i // 2 * 3 + (3600 if i > 80 else 0)), 1.0) for i in range(120)]
    schema = "client string, request_id bigint, ts timestamp, cost double"
    want = {x.request_id: x.wait_s for x in jobs.admissions(spark.createDataFrame(log, schema), per_minute=6, burst=3).collect()}
    batches = [log[i : i + 40] for i in range(0, 120, 40)]
    for k in range(2):  # neighbours of a batch's end arrive in the wrong batch, all in any order
        batches[k][-6:], batches[k + 1][:6] = batches[k + 1][:6], batches[k][-6:]
    for b in batches:
        r.shuffle(b)
    files = [spark.createDataFrame(b, schema) for b in [*batches, [("end", 999, t0 + dt.timedelta(days=1), 1.0)]]]
    assert _admitted(spark, tmp_path, files, late="2 hours", per_minute=6, burst=3) == want


def test_capped_calls_of_a_stream_equal_the_table(spark, tmp_path):
    """Any order within the bound; failures count, refused calls do not; a batch that runs again changes nothing."""
    import random

    r, t0 = random.Random(6), dt.datetime(2024, 3, 1, 20)
    log = [(f"d{r.randrange(14)}", ["net_contents"], t0 + dt.timedelta(minutes=11 * i), r.random() < 0.7) for i in range(150)]
    df = spark.createDataFrame(log, jobs.CappedCalls.SCHEMA)
    key = lambda rows: sorted((x.digest, x.ts, x.outcome) for x in rows)
    want = key(second_reading.daily_cap(df, 5).collect())
    assert {o for *_, o in want} == {"paid", "cached", "refused"}
    calls = jobs.CappedCalls(spark, 5, late="3 hours", folder=str(tmp_path / "calls"))
    batches = [log[i : i + 50] for i in range(0, 150, 50)]
    batches[0][-7:], batches[1][:7] = batches[1][:7], batches[0][-7:]
    for k, b in enumerate(batches):
        r.shuffle(b)
        calls.step(spark.createDataFrame(b, df.schema), k)
        if k == 1:
            calls.step(spark.createDataFrame(b, df.schema), k)
    calls.last = 2
    calls.close()
    assert key(calls.decided().collect()) == want
    short = jobs.CappedCalls(spark, 5, late="3 hours", keep="1 hour", folder=str(tmp_path / "short"))
    for k, b in enumerate(batches):
        short.step(spark.createDataFrame(b, df.schema), k)
    assert short.table("known", 2, "key string, paid_at timestamp").count() < calls.table("known", 2, "key string, paid_at timestamp").count()


def test_streamed_counts_equal_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t0 + dt.timedelta(minutes=7 * i), ("pass", "flag", "fail")[i % 3]) for i in range(40)], "ts timestamp, verdict string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.verdict_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), late="1 minute")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(45)
    key = lambda rows: sorted((r.window_start, r.verdict, r.n) for r in rows)
    assert key(spark.table("counts").collect()) == key(jobs.verdict_counts(df).collect())


def test_queue_file(spark, tmp_path):
    checks = "array<struct<field:string,verdict:string>>"
    df = spark.createDataFrame([("=1+1", "flag", [("net_contents", "flag")], 1234, 0.85, None)], f"cola_id string, verdict string, checks {checks}, elapsed_ms int, triage_p double, error string")
    sinks.write_queue(df.coalesce(1), str(tmp_path / "q"))
    body = next((tmp_path / "q").glob("part-*.csv")).read_bytes()
    assert body == "﻿".join(["", '"COLA ID","Result","Findings","Seconds","Chance of a genuine defect","Triage by"\r\n"\'=1+1","Review","net contents (review)","1.2","85%","heuristic"\r\n']).encode() or body.startswith(b'"\xef\xbb\xbfCOLA ID"')


def test_running_sums_equal_the_plain_window(spark):
    """A group of nearly all rows, a null group, repeated order keys, null values; an empty table."""
    rows = spark.range(0, 3000, 1, 7).select(
        F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 20 == 0, "few").otherwise("most").alias("batch"), (F.col("id") * 7919 % 3000).alias("place"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("n"), F.lit("x").alias("range_no"),
    )
    w = Window.partitionBy("batch").orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = rows.withColumns({"total": F.sum("n").over(w), "at": F.count("*").over(w)}).fillna(0, ["total"])
    order = [F.col("place").desc()]
    got = running(rows, order, ["batch"], total=F.coalesce("n", F.lit(0)), at=F.lit(1))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert running(rows.limit(0), order, ["batch"], at=F.lit(1)).collect() == []
    whole = running(rows, [F.col("place")], [], at=F.lit(1)).orderBy("place").collect()
    assert [r["at"] for r in whole] == list(range(1, 3001))
