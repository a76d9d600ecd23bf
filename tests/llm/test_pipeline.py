"""The pipeline as a whole: what it drops, cuts and packs."""

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm.common import table, written
from plumbline.llm.packing import token_bytes


def test_stages_against_plain_versions(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    stages = dict(corpus_pipeline.STAGES)
    clean = written(stages["toxicity"](spark, docs, sf_dir), "t1")
    assert clean.columns == docs.columns and 0 < docs.count() - clean.count() < 0.3 * docs.count()
    assert clean.exceptAll(docs).count() == 0
    rows = {r.doc_id: r.text for r in clean.collect()}

    one = written(stages["exact_dedup"](spark, clean, sf_dir), "t2")
    best = {}
    for i, t in rows.items():
        k = brute.SPACE.sub("", t or "")
        best[k] = min(best.get(k, (0, 1 << 60)), (-len(t or ""), i))
    assert {r.doc_id for r in one.collect()} == {i for _, i in best.values()}

    two = written(stages["near_dedup"](spark, one, sf_dir), "t3")
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert {r.doc_id for r in two.collect()} == {i for i, (_, c) in brute.simhash(rows).items() if i == c}

    three = written(stages["substring_dedup"](spark, two, sf_dir), "t4")
    assert three.schema == docs.schema
    before = {r.doc_id: r.text for r in two.collect()}
    want = brute.substring_dedup(list(before.items()))
    for r in three.collect():
        n, gone, sha = want[r.doc_id]
        assert r.text == before[r.doc_id] if not gone else (brute.sha(r.text.encode()) == sha and r.n_chars == len(r.text))

    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = stages["pack"](spark, three, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == {r.doc_id: len(token_bytes(r.text, path)) // 4 + 1 for r in three.collect()}


def test_stages_on_odd_rows(spark, sf_dir, make, odd_rows):
    docs = make([*odd_rows, (None, "some words here"), (20, None)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf_dir), name)
        assert out.columns == docs.columns
        docs = out
    ids = {r.doc_id for r in docs.collect()}
    assert None in ids and 13 in ids and 3 in ids and not ids & {1, 2, 20}  # 3 has the longest text without a word
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()


def test_stages_on_empty_tables(spark, sf_dir, make):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, make([]), sf_dir).count() == 0


def test_repeated_rows_and_ids(spark, sf_dir, make):
    """Rows that repeat in full leave one; rows that share an id and differ are documents of their own."""
    stages = dict(corpus_pipeline.STAGES)
    t, u = "one text of some words here", "quite another text with other words in it"
    docs = make([(1, t), (1, t), (2, "x  y z"), (2, "q w e"), (3, "q w e"), (4, "x y  z "), (5, u), (5, u), (None, t), (None, None), (None, None)])
    for name in ("exact_dedup", "near_dedup"):
        out = stages[name](spark, docs, sf_dir)
        assert out.columns == docs.columns
        got = sorted([(r.doc_id, r.text) for r in out.collect()], key=str)
        longest = (4, "x y  z ") if name == "exact_dedup" else None
        if name == "exact_dedup":  # a null id sorts before all others
            assert got == sorted([(None, t), longest, (2, "q w e"), (5, u), (None, None)], key=str)
        else:  # a null id stays only where no other is left
            assert got == sorted([(1, t), (2, "x  y z"), (2, "q w e"), (5, u), (None, None)], key=str)


def test_texts_that_share_an_id_are_cut_apart(spark, sf_dir, make):
    one, two = (" ".join(f"{x}{i}" for i in range(70)) for x in "ab")
    rows = [(1, one), (2, two), (2, f"x y {one}"), (3, f"{two} end"), (3, f"{two} end"), (None, one)]
    out = dict(corpus_pipeline.STAGES)["substring_dedup"](spark, make(rows), sf_dir)
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == sorted([(1, one), (2, two), (2, "x y"), (3, "end"), (3, "end"), (None, one)], key=str)


def test_columns_that_clash(spark, sf_dir):
    text = " ".join(f"t{i}" for i in range(80))
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans int, key string, _key long, place int, kept boolean, fp long, label long, node long, score double"
    docs = spark.createDataFrame([(i, text if i < 3 else f"{i} other words", None, "s", 5, i, "k", 7, 1, True, 0, 0, 0, 0.0) for i in (1, 1, 2, 3, 4)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema == docs.schema, name
        assert out.count() == {"toxicity": 5, "exact_dedup": 3, "near_dedup": 3, "substring_dedup": 5}[name]


def test_run_leaves_no_tables_of_its_stages(spark, sf_dir):
    import os

    from plumbline.sources.tables import run_folder

    folder = run_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    corpus_pipeline.run(spark, sf_dir).count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left <= {"stage-substring_dedup", "pieces"}
