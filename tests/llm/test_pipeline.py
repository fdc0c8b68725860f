"""The pipeline's decisions on planted cases, and its registered form."""

import corpus_pipeline
from proofline.llm import entries
from tests.llm import test_operators as ops
from tests.llm.conftest import table


def test_stages(spark, tmp_path):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    bench = "what is the name of the long river that runs by the old town"
    rows = [(1, words("a", 100)), (2, words("a", 99) + " zz"), (3, words("b", 90) + " " + bench + " end"), (4, words("c", 80) + " mail me@site.example.org now"), (5, "too short"), (6, "again and again " * 60), (7, None), (8, words("d", 300))]
    docs = table(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, kept = docs, []
    for _, f in corpus_pipeline.STAGES[:-1]:
        left = f(spark, left, str(tmp_path)).cache()
        kept.append(sorted(r.doc_id for r in left.collect()))
        assert left.columns == docs.columns
    assert kept == [[1, 2, 3, 4, 8], [1, 3, 4, 8], [1, 4, 8], [1, 4, 8]]
    four = left.filter("doc_id = 4").first()
    assert "[EMAIL]" in four.text and four.n_chars == len(four.text)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {1, 4, 8}


def test_near_copies_between_80_and_85_percent_go(spark):
    """400 words and the same with 80 more: similarity 0.83; with 110 more: 0.78."""
    w = [f"w{i}" for i in range(400)]
    more = lambda tag, n: " ".join([*(f"{tag}{x}" for x in w), *(f"{tag}new{i}" for i in range(n))])
    docs = table(spark, [(1, more("a", 0)), (2, more("a", 80)), (3, more("b", 0)), (4, more("b", 110))])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dups(spark, docs, "").collect()) == [1, 3, 4]


def test_rows_with_one_id_or_none_stand_for_themselves(spark, tmp_path):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    bench = words("q", 12)
    rows = [(None, words("a", 60)), (None, words("a", 60)), (None, words("b", 60)), (4, words("c", 60)), (4, words("c", 60)), (4, words("d", 60)), (None, words("d", 60)), (5, None), (5, "")]
    left = corpus_pipeline.near_dups(spark, table(spark, rows), "").collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:1]) for r in left) == [(0, "a"), (0, "b"), (4, "c"), (4, "d"), (5, ""), (5, "")]
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, bench), (None, words("a", 60)), (4, "x " + bench), (4, words("b", 60)), (6, None)]
    left = corpus_pipeline.decontaminate(spark, table(spark, rows), str(tmp_path))
    assert sorted((r.doc_id or 0, (r.text or "")[:1]) for r in left.collect()) == [(0, "a"), (4, "b"), (6, "")] and left.columns == table(spark, []).columns


def test_all_operators_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in entries.QUERIES}) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dups", "decontaminate", "pii", "pack"]


def brute(rows, items):
    """What the stages leave of (doc_id, text) rows: row numbers, by plain loops over all pairs."""
    kept = []
    for k, (_, t) in enumerate(rows):
        n, _, _, _, three, eight, longest = ops.quality_brute(t)
        if n >= 50 and 100 * three <= 50 * n and 100 * eight <= 40 * n and not (longest >= 8 and 100 * longest > 30 * n):
            kept.append(k)
    comp = {k: c for k, _, c, _ in ops.near_brute([(k, rows[k][1]) for k in kept], size=5, percent=80)}
    first = {}
    for k in kept:
        i = rows[k][0]
        first[comp[k]] = min(first.get(comp[k], (2, 0, 0)), (i is None, i or 0, k))
    kept = [k for k in kept if first[comp[k]][2] == k]
    dirty = {k for k, *_, hit in ops.windows_brute([(k, rows[k][1]) for k in kept], items) if hit}
    return [k for k in kept if k not in dirty]


def test_pipeline_equals_brute_force(spark, rows, tmp_path):
    """Nulls, empty and repeated texts, one id or none for several rows, copies, near copies, passages, personal data."""
    rows = [r for r in rows if r[0] != 50]  # too long for the brute force of the longest repeat
    base = rows[6][1].split()
    rows += [(None, rows[20][1]), (7, None), (7, rows[8][1]), (None, ""), (11, rows[8][1]), (None, " ".join(base[:100] + ["zz"] + base[100:])), (13, " ".join(base[:160]))]
    rows += [(200 + k, f"{rows[30 + k][1]} write to person{k}@mail.example.org or +44 20 7946 095{k}") for k in range(4)]
    items = [(1, " ".join(rows[34][1].split()[5:30])), (2, None), (3, ""), (None, " ".join(rows[35][1].split()[3:14]))]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = brute(rows, items)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, str(tmp_path)).cache()
    got = docs.collect()
    texts = sorted((rows[k][0] or -1, rows[k][1]) for k in left)
    clean = sorted((i, t) for i, t in texts if not ops.pii_brute(t))
    assert sorted(r.doc_id or -1 for r in got) == [i for i, _ in texts] and set(clean) <= {(r.doc_id or -1, r.text) for r in got}
    assert all(not ops.pii_brute(r.text) and r.n_chars == len(r.text) for r in got) and any(ops.pii_brute(t) for _, t in texts)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(ops.BPE)
    want = sorted((r.doc_id or -1, ops.crc(tok.encode(r.text, add_special_tokens=False).ids + [1])) for r in got if len(r.text) < 4000)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in packed) == sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in got)
    assert {(r.doc_id or -1, r.ids_crc32) for r in packed if r.length == r.doc_tokens} <= set(want)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_documents_without_an_id(spark):
    """A null id stays null, and such rows are worked on like any other."""
    from proofline.llm import decontamination, pii, quality

    t = "one two three four five six seven eight nine ten eleven twelve mail a.b@c.example.com"
    docs = table(spark, [(None, t), (None, t), (3, None)])
    items = spark.createDataFrame([(1, t)], "item_id bigint, text string")
    hit = decontamination.report(decontamination.find_contamination(docs, items)).collect()
    assert sorted((r.doc_id is None, r.n_hit, r.contaminated) for r in hit) == [(False, 0, False), (True, 18, True), (True, 18, True)]
    good = quality.quality(docs).collect()
    assert sorted((r.doc_id is None, r.n_words) for r in good) == [(False, 0), (True, 14), (True, 14)]
    found = pii.find_pii(docs).collect()
    assert sorted((r.doc_id is None, r.n_email) for r in found) == [(False, 0), (True, 1), (True, 1)]
