"""Edges of the core: option literals, digits of other scripts, NaN, overflow, retries, judges, tables."""

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.functions import text
from plumbline.operators import prompts, pruning, sampling
from plumbline.plans import judging, selection
from plumbline.sources import jsonl, scorer, tables

LITERALS = [
    ("['a', None]", "A. a\nB. None\n"),
    ("['a, None, b', \"it's\", True, 3, 2.5,]", "A. a, None, b\nB. it's\nC. True\nD. 3\nE. 2.5\n"),
    (r"['it\'s', 'x\\y']", "A. it's\nB. x\\y\n"),
    ("['" + "long " * 5000 + "']", "A. " + "long " * 5000 + "\n"),
    ("[]", ""),
    ("{'a': 1}", ""),
    ("('a', 'b')", ""),
    ("oops", ""),
    ("", ""),
    (None, ""),
]


def test_option_literals(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(LITERALS)], "i int, x string")
    got = [r.y for r in df.select("i", prompts.option_list(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [y for _, y in LITERALS]
    listed = spark.createDataFrame([(["a", None],)], "o array<string>").select(prompts.option_letters(F.col("o")).alias("y"))
    assert listed.first().y == "A. a\nB. None\n"


@pytest.mark.parametrize("answer, want", [("$\t5", "5"), ("٣٤", "34"), ("３.５", "3.5"), ("1\t2", "1\t2"), ("𝟗", "9"), ("x٣", "x٣"), ("-٠٧", "-7")])
def test_numbers_as_they_are_read(spark, answer, want):
    df = spark.createDataFrame([(answer,)], "a string")
    assert df.select(text.normalize_veto(F.col("a"))).first()[0] == want


@pytest.mark.parametrize("answer, want", [("B ist groß ß.", "ẞ"), ("b ßß", "B"), ("c ŉ", "ŉ"), ("c ᾳ", "ᾼ"), ("c ĸ1 ä", "Ä"), ("ß a", "A")])
def test_a_letter_stays_one_in_upper_case(spark, answer, want):
    df = spark.createDataFrame([(answer,)], "a string")
    assert df.select(text.extract_fix(F.col("a"))).first()[0] == want


def test_nan_among_values_makes_thresholds_nan(spark):
    for rows in ([float("nan"), 1.0, 2.0], [1.0, 2.0, float("nan")]):
        v = spark.createDataFrame([(x,) for x in rows], "j double")
        for f in (pruning.thresholds, pruning.exact_thresholds):
            r = f(v, "j", 10, 90).first()
            assert r.t_hi != r.t_hi and r.t_lo != r.t_lo, f
            off = f(v, "j", 0, -1).first()
            assert tuple(off) == (10000.0, 10000.0)
    nulls = spark.createDataFrame([(None,), (1.0,), (3.0,)], "j double")
    assert tuple(pruning.thresholds(nulls, "j", 50, 50).first()) == tuple(pruning.exact_thresholds(nulls, "j", 50, 50).first()) == (2.0, 2.0)
    pool = spark.createDataFrame([(1, 100.0, 0.5), (1, 100.0, 0.1)], "question_id long, score double, jitter double")
    limits = spark.createDataFrame([(float("nan"), float("nan"))], "t_hi double, t_lo double")
    assert pruning.veto_or_all_long(pool, 100, limits).count() == 2
    assert pruning.veto_or_all_long(pool.withColumn("score", F.lit(0.0)), 100, limits).count() == 2


def scored(i, logprobs):
    c = [{"extracted_answer": "A", "is_correct": True, "token_logprobs": x, "interval_scores": [100]} for x in logprobs]
    return json.dumps({"question_id": i, "gold_answer": "A", "candidates": c})


def test_records_beyond_doubles_are_dropped(spark):
    lines = spark.createDataFrame([(scored("ok", [[-1.0, None], None]),), (scored("big", [[-1.0], [800.0]]),), (scored("inf", [[float("inf")]]),), (scored("edge", [[709.0]]),)], "value string")
    records = jsonl.tolerant(lines, schemas.SCORED)
    assert sorted(r.question_id for r in selection.features(records).collect()) == ["edge", "inf", "ok"]
    for large in (True, False):
        assert selection.report(records, large=large).count() == 3
    first = schemas.SelectionConfig(sample_e=1)  # the slice is all that is read
    assert selection.features(records, first).count() == 4


def test_generator_retries(spark):
    def factory():
        calls = {}

        def make(prompt, n):
            k = calls[prompt] = calls.get(prompt, 0) + 1
            if prompt == "never" or prompt == "large" and n > 1 or prompt == "late" and k % 5:
                raise RuntimeError("out of memory")
            return [{"text": str(n)}] * n

        return make

    df = spark.createDataFrame([("never",), ("large",), ("late",), ("good",)], "prompt string").coalesce(1)
    n = lambda **how: {r.prompt: r.n for r in scorer.generated(df, "prompt", factory, "text string", schemas.SamplingConfig(n_samples=6, **how)).groupBy("prompt").agg(F.count("*").alias("n")).collect()}
    # Five failures in a row end a question; a failure of a larger batch lowers it to one and isn't counted.
    assert n(retries=5, micro_batch=1) == {"late": 6, "good": 6, "large": 6}
    assert n(retries=4, micro_batch=1) == {"good": 6, "large": 6}
    assert n(retries=5, micro_batch=4) == {"late": 6, "good": 6, "large": 6}
    # Without retries a failure skips its batch; there are six singles, or a four and a two.
    assert n(micro_batch=1) == {"late": 1, "good": 6, "large": 6}
    assert n(micro_batch=4) == {"good": 6}


class Endpoint(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        asked = body["messages"][-1]["content"]
        if "fail" in asked:
            self.send_response(500)
            self.end_headers()
            return
        ok = body["temperature"] == 0 and body["response_format"] == {"type": "json_object"} and self.headers["Authorization"] == "Bearer k"
        reply = json.dumps({"choices": [{"message": {"content": json.dumps({"extracted_answer": "7", "is_correct": ok})}}]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(reply)

    def log_message(self, *a):
        pass


def test_judge_behind_an_endpoint(spark):
    server = HTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        kind = "question_id string, question string, answer string, candidates array<struct<full_text:string,extracted_answer:string,is_correct:boolean>>"
        df = spark.createDataFrame([("a", "q", "7", [("....", None, False)]), ("b", "q", "7", [("fail ....", None, False)])], kind)
        fixed = judging.fix_records(df)
        asked = judging.to_judge(fixed)
        assert all("Question:\nq\n" in r.prompt and "Reference answer:\n7\n" in r.prompt and "....\n" in r.prompt for r in asked.collect())
        said = scorer.scored_batches(asked, "prompt", "reply", scorer.http_judge(f"http://127.0.0.1:{server.server_port}/v1", "m", "k"))
        got = {r.question_id: (r.candidates[0].extracted_answer, r.candidates[0].is_correct) for r in judging.with_verdicts(fixed, said).collect()}
        assert got == {"a": ("7", True), "b": (None, False)}
    finally:
        server.shutdown()


def test_records_of_the_scoring_stage(spark, tmp_path):
    c = {"text": "given one\n\ntwo", "extracted_answer": None, "is_correct": False, "token_logprobs": []}
    stats = {"total": 1, "correct": 0, "accuracy": 0.0}
    rows = [{"question_id": "a", "continuations": [c], "full_poisoned_prefix": "given", "stats": stats}, {"question_id": "b", "candidates": [c]}, {"question_id": "c", "candidates": []}, {"question_id": "d", "candidates": [{**c, "text": None}], "stats": stats}]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, rows)))
    records = jsonl.read_to_score(spark, str(tmp_path))
    kept = judging.scorable(records)
    assert sorted(r.question_id for r in kept.collect()) == ["a", "c"]
    plain = [r.slice for r in judging.slices_of(kept).orderBy("slice_idx").collect()]
    apart = [r.slice for r in judging.slices_of(kept, schemas.SamplingConfig(poisoned=True)).orderBy("slice_idx").collect()]
    assert plain == ["given one\n\ntwo", "given one"] and apart == ["given\none\n\ntwo", "given\none"]
    out = {r.question_id: r for r in judging.with_scores(records, scorer.confidence_scores(judging.slices_of(kept))).collect()}
    assert set(out) == {"a", "c"} and out["c"].stats is None and len(out["a"].candidates[0].interval_scores) == 2


def test_think_blocks_are_not_asked_about(spark):
    df = spark.createDataFrame([("q", 0, 0, "p", " <think>no\n</think>yes "), ("q", 1, 0, "p", "yes")], "question_id string, pos int, slice_idx int, problem string, slice string")
    scores = scorer.confidence_scores(df, rubric="steps").collect()
    assert len({r.score for r in scores}) == 1
    assert len(set(prompts.RUBRICS.values())) == len(prompts.RUBRICS) == 4


def test_samples_follow_the_seed(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    take = lambda seed: {r.k for r in sampling.hash_sample(df, "k", 50, seed).collect()}
    assert take(1) == take(1) != take(2) and len(take(2)) == 50 and len(take(None)) == 50


def test_parts(spark, tmp_path):
    jsonl.write_records(spark.range(5), str(tmp_path / "a"))
    paths = [str(tmp_path / "a"), str(tmp_path / "none")]
    assert jsonl.merge_parts(spark, paths, spark.range(1).schema).count() == 5
    assert jsonl.merge_parts(spark, paths[1:], spark.range(1).schema).count() == 0
    assert sorted(tuple(r) for r in jsonl.part_counts(spark, paths).collect()) == [(0, True, 5), (1, False, 0)]


def test_tables_go_with_their_scope(spark):
    here = lambda df: os.path.isdir(df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0].replace("//", "/"))
    with tables.scope(spark):
        inner = tables.materialised(spark.range(3), "inner")
        with tables.scope(spark):
            deep = tables.materialised(spark.range(3), "deep")
            kept = tables.materialised(spark.range(4), "kept", outer=True)
            assert here(deep)
        assert not here(deep) and here(kept) and here(inner)
    assert not here(kept) and not here(inner)
    free = tables.materialised(spark.range(2), "free")
    assert here(free) and free.count() == 2



def plain_ends(steps, n, flag):
    """Ends of intervals by a fold, as numbers of steps."""
    target = (sum(map(len, steps)) + (len(steps) - 1) * len(flag)) / max(1, n)
    ends, size = [], 0
    for at, x in enumerate(steps, 1):
        size += len(x) + len(flag)
        if size >= target and len(ends) < n - 1:
            ends.append(at)
            size = 0
    return ends if ends and ends[-1] == len(steps) else [*ends, len(steps)]


def test_segmentation_is_a_fold(spark):
    """Arrays and long rows against the fold, with ends that fall on a target to the letter, and one step of most."""
    import random

    from plumbline.functions import arrays
    from plumbline.plans import segments

    draw = random.Random(3)
    texts = [["a" * draw.choice([1, 1, 2, 5, 40]) for _ in range(draw.randint(1, 30))] for _ in range(40)] + [["x" * 1000, *["y"] * 20], ["ab"] * 12, ["abc"]]
    df = spark.createDataFrame(list(enumerate(texts)), "key int, steps array<string>")
    rows = df.select("key", F.posexplode("steps").alias("step", "x")).select("key", "step", F.length("x").alias("length"))
    for n in (1, 2, 3, 7, 10, 64):
        want = {k: plain_ends(t, n, "\n\n") for k, t in enumerate(texts)}
        assert {r.key: r.e for r in df.select("key", arrays.interval_ends(F.col("steps"), n).alias("e")).collect()} == want
        long = segments.segments(rows, n, 2).groupBy("key", "segment").agg((F.max("step") + 1).alias("end"))
        got = {}
        for r in long.collect():
            got.setdefault(r.key, []).append(r.end)
        assert {k: sorted(v) for k, v in got.items()} == want


def test_cumulative_slices_of_odd_texts(spark):
    from plumbline.functions import arrays

    df = spark.createDataFrame([("",), ("  \n\n ",), ("one",), ("lead one\n\ntwo\n\n\n\nthree<|im_end|>",), (None,)], "t string")
    got = [r.s for r in df.select(arrays.cumulative_slices(F.col("t"), 3, prefix=F.lit(" lead ")).alias("s")).collect()]
    assert got[:4] == [[""], [""], ["lead\none"], ["lead\none", "lead\none\n\ntwo", "lead\none\n\ntwo\n\nthree"]]
    pair = df.select(arrays.cumulative_slices(F.col("t"), 3).alias("all"), arrays.interval_slices(F.col("t"), 3).alias("two")).collect()
    assert all(r.two == ([r.all[-1], r.all[0]] if len(r.all) > 1 else r.all) for r in pair[:4])


def test_intervals_take_time_in_proportion_to_the_steps(spark):
    """A text of many steps: what holds for the text isn't worked out anew for each."""
    import time

    from plumbline.functions import arrays

    steps = F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.lit("ab"))
    df = spark.range(1).select(F.array_join(steps, "\n").alias("t"))
    began = time.time()
    ends = arrays.interval_ends(F.filter(F.split("t", "\n"), lambda x: x != ""), 10, "\n")
    row = df.select(ends.alias("e"), F.size(arrays.cumulative_slices(F.col("t"), 10, "\n")).alias("n"), F.size(arrays.interval_slices(F.col("t"), 10, "\n")).alias("two")).first()
    assert row.e == [2000 * i for i in range(1, 11)] and (row.n, row.two) == (10, 2)
    assert time.time() - began < 20


def test_segments_send_nothing_to_all_tasks(spark, monkeypatch):
    """Every join of the plans is by shuffle, though the tables are small here."""
    from plumbline.plans import segments

    seen = []
    written = segments.materialised

    def kept(df, label):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    monkeypatch.setattr(segments, "materialised", kept)
    rows = spark.range(40).selectExpr("id % 4 as key", "cast(id div 4 as int) as step", "3 as length")
    out = segments.segments(rows, 10, 1)
    seen.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == 40
    assert not [p for p in seen if "Broadcast" in p] and any("SortMergeJoin" in p for p in seen)
