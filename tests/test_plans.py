"""Sources, stages and plans from JSON lines to report."""

import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schemas
from plumbline.plans import judging, sampling, selection
from plumbline.sources import jsonl, scorer
from plumbline.streaming import apply


def record(i, answers, gold="A", scores=None):
    c = [{"text": f"so \\boxed{{{a}}}" if a else "none", "extracted_answer": a, "is_correct": False, "token_logprobs": [-0.1 * ((k * (j + 1)) % 7) for k in range(60)], "interval_scores": [s]} for j, (a, s) in enumerate(zip(answers, scores or [100] * len(answers)))]
    return {"question_id": i, "problem": "p", "gold_answer": gold, "candidates": c, "stats": {"total": len(c), "correct": 0, "accuracy": 0.0}}


@pytest.fixture()
def lines(tmp_path):
    rows = [json.dumps(record("q1", ["B", "A", "A", None])), "", "{bad", '{"candidates": null}', '{"candidates": []}', json.dumps(record("q2", ["C", "D"], scores=[0, 10])), '{"question_id": "x", "candidates": 5}', json.dumps({**record("q3", ["A"]), "candidates": [{"extracted_answer": "A", "token_logprobs": None}]})]
    p = tmp_path / "in.jsonl"
    p.write_text("\n".join(rows))
    return str(p)


def test_tolerant_source(spark, lines):
    got = jsonl.read_scored(spark, lines)
    assert sorted(r.question_id for r in got.collect()) == ["q1", "q2", "q3"]


def test_strict_source_fails(spark, lines, tmp_path):
    with pytest.raises(Exception):
        jsonl.read_strict(spark, lines, schemas.SCORED).collect()
    good = tmp_path / "good.jsonl"
    good.write_text(json.dumps(record("q", ["A"])) + "\n\n")
    assert jsonl.read_strict(spark, str(good), schemas.SCORED).count() == 1


def test_report_of_records(spark, lines, tmp_path):
    records = jsonl.read_scored(spark, lines)
    out = selection.report(records)
    assert [f.name for f in out.schema] == [f.name for f in schemas.REPORT]
    by = {r.question_id: r for r in out.collect()}
    # The most jittery of q1's candidates, an A, is vetoed; of three answers the first then wins.
    q = by["q1"]
    assert (q.is_correct, q.strategy, q.is_same_as_base, q.pool_size, q.current_score) == (False, "JITTER", False, 1, [100.0])
    assert (q.baseline_confidence, q.final_confidence, q.final_ans_original_ratio) == (0.5, pytest.approx(1 / 3), 0.25)
    assert by["q3"].is_correct and by["q3"].current_score == [0.0]
    assert {r.question_id: r for r in selection.report(records, large=False).collect()} == by
    jsonl.write_records(out, str(tmp_path / "out"), 1)
    back = jsonl.merge_parts(spark, [str(tmp_path / "out")], schemas.REPORT)
    assert back.count() == 3 and "current_corrrect" in back.columns


def test_report_reads_no_texts_and_shuffles_once(spark, lines, tmp_path):
    jsonl.read_scored(spark, lines).write.parquet(str(tmp_path / "s3"))
    df = selection.report(spark.read.parquet(str(tmp_path / "s3")), large=False)
    plan = df._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "hashpartitioning" not in physical  # votes need no exchange; the percentile's goes to one partition
    assert all("text:" not in x for x in physical.split("ReadSchema: ")[1:])


def test_metrics(spark, lines):
    got = {r.run: r for r in selection.metrics(selection.selected(selection.features(jsonl.read_scored(spark, lines)))).collect()}
    assert got["baseline"].accuracy == pytest.approx(200 / 3) and got["final"].mean_pool_size <= got["baseline"].mean_pool_size
    none = selection.metrics(selection.selected(selection.features(jsonl.read_scored(spark, lines).where("false"))))
    assert sorted(tuple(r) for r in none.collect()) == [("baseline", 0.0, 0.0, 0.0), ("final", 0.0, 0.0, 0.0)]


def test_slice_of_candidates(spark, lines):
    config = schemas.SelectionConfig(sample_s=1, sample_e=3)
    got = {r.question_id: len(r.pool) for r in selection.features(jsonl.read_scored(spark, lines), config).collect()}
    assert got == {"q1": 2, "q2": 1}


def test_stream_equals_batch(spark, lines, tmp_path):
    src = tmp_path / "stream"
    src.mkdir()
    (src / "a.jsonl").write_text(open(lines).read())
    limits = spark.createDataFrame([(0.3, 0.01)], "t_hi double, t_lo double")
    q = apply.report_stream(apply.scored_stream(spark, str(src)), limits).writeStream.format("memory").queryName("reports").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    pools = selection.features(jsonl.read_scored(spark, lines))
    want = selection.report_rows(selection.selected(pools, limits=limits))
    ids = lambda df: sorted(map(str, df.collect()))
    # Null records of the stream have no candidates and so no report.
    assert ids(spark.table("reports")) == ids(want)


def test_fix_judge_and_verdicts(spark):
    rows = [("q", "p", "A", [("so \\boxed{A}", None, False, None), ("....", None, False, None), ("x", "B", True, None)])]
    df = spark.createDataFrame(rows, "question_id string, problem string, gold_answer string, candidates array<struct<text:string,extracted_answer:string,is_correct:boolean,token_logprobs:array<double>>>")
    fixed = judging.fix_records(df)
    r = fixed.first()
    assert [(c.extracted_answer, c.is_correct) for c in r.candidates] == [("A", True), (None, False), ("B", False)] and tuple(r.stats) == (3, 1, pytest.approx(1 / 3))
    asked = judging.to_judge(fixed)
    assert [x.pos for x in asked.collect()] == [1]
    said = scorer.scored_batches(asked, "prompt", "reply", lambda: lambda texts: ['{"extracted_answer": "C", "is_correct": true}' for _ in texts])
    r = judging.with_verdicts(fixed, said).first()
    assert (r.candidates[1].extracted_answer, r.candidates[1].is_correct) == ("C", True) and r.stats.correct == 2
    broken = said.withColumn("reply", F.lit("not json"))
    assert judging.with_verdicts(fixed, broken).first().stats.correct == 1


@pytest.mark.parametrize("gold, answer, want", [("42", None, True), ("A", "A", True), ("", None, True), ("(B)", "B", True), ("A", None, False)])
def test_gold_of_any_length(spark, gold, answer, want):
    df = spark.createDataFrame([(gold, answer)], "g string, a string")
    assert df.select(judging.rejudged(F.col("a"), judging.gold_letter(F.col("g")))).first()[0] is want


def test_scores_come_back(spark):
    df = spark.createDataFrame([("q", "p", "A", [("a\n\nb", None), ("c", None)], (2, 0, 0.0))], "question_id string, problem string, gold_answer string, candidates array<struct<text:string,extracted_answer:string>>, stats struct<total:int,correct:int,accuracy:double>")
    s = scorer.confidence_scores(judging.slices_of(df), batch=2)
    assert s.count() == 3
    r = judging.with_scores(df, s).first()
    assert len(r.candidates[0].interval_scores) == 2 and r.stats.avg_confidence == pytest.approx(sum(c.avg_verbal_score for c in r.candidates) / 2)
    none = judging.with_scores(df, s.where("false")).first()
    assert none.candidates[0].interval_scores == [] and none.stats.avg_confidence == 0


def test_failed_batches_get_the_default(spark):
    def bad():
        def score(texts):
            raise RuntimeError

        return score

    df = spark.createDataFrame([("a",), ("b",)], "t string")
    assert [r.y for r in scorer.scored_batches(df, "t", "y", bad, on_error="0").collect()] == ["0", "0"]


def test_generated_candidates(spark):
    df = spark.createDataFrame([("q", "ask")], "question_id string, prompt string")
    got = scorer.generated(df, "prompt", lambda: lambda p, n: [{"text": f"{p}{i}"} for i in range(n)], "text string", schemas.SamplingConfig(n_samples=3, micro_batch=3))
    assert [(r.pos, r.candidate.text) for r in got.orderBy("pos").collect()] == [(0, "ask0"), (1, "ask1"), (2, "ask2")]


def test_questions_from_parquet(spark, tmp_path):
    spark.createDataFrame([(1, "", "alt", 5)], "id long, question string, prompt string, answer int").write.parquet(str(tmp_path / "q"))
    r = jsonl.read_questions(spark, str(tmp_path / "q")).first()
    assert (r.question_id, r.problem, r.gold_answer) == (1, "alt", "5")


def test_command_line(spark, lines, tmp_path, capsys):
    from plumbline.__main__ import main

    main(["--input", lines, "--output", str(tmp_path / "report"), "--sample_e", "4"], spark)
    assert spark.read.schema(schemas.REPORT).json(str(tmp_path / "report")).count() == 3
    assert "accuracy" in capsys.readouterr().out


def test_questions_are_asked(spark):
    df = spark.createDataFrame([(1, "q1", "A", "['x', 'y']", "multiple-choice"), (2, "q2", "B", "not a list", "open"), (3, "q3", "B", "oops", "multiple-choice")], "id long, question string, answer string, options string, question_type string")
    got = {r.question_id: r.prompt for r in sampling.asked(df, visual=True).collect()}
    assert got[1].startswith("q1\n\nOptions:\nA. x\nB. y\n\n\n") and got[3].startswith("q3\n\n") and 2 not in got
    st = spark.createDataFrame([(1, "q", (["A", "B"], ["x", "y"]))], "id long, question string, choices struct<label:array<string>,text:array<string>>")
    assert sampling.asked(st).first().prompt.startswith("Question: q\nOptions:\nA. x\nB. y\n\n")


RECORD = "question_id string, problem string, gold_answer string, said string, candidates array<struct<text:string,extracted_answer:string,is_correct:boolean>>, stats struct<total:int,correct:int,accuracy:double>"


def repeated_records(spark):
    """Two records of one id, one of them twice, and a null id."""
    c = lambda *texts: [(t, None, False) for t in texts]
    rows = [("q", "p", "A", "x", c("....", "1"), (2, 0, 0.0)), ("q", "p", "A", "y", c("2"), (1, 0, 0.0)), ("q", "p", "A", "y", c("2"), (1, 0, 0.0)), (None, "p", "A", "z", c("3"), (1, 0, 0.0))]
    return spark.createDataFrame(rows, RECORD)


def test_records_that_share_an_id_keep_their_own(spark, tmp_path):
    def judge(texts):
        return ['{"extracted_answer": "%s", "is_correct": true}' % t.split("Response:\n")[1].split("\n")[0] for t in texts]

    ask = lambda asked: scorer.scored_batches(asked, "prompt", "reply", lambda: judge)
    repeated_records(spark).coalesce(1).write.parquet(str(tmp_path / "r"))
    for records in (repeated_records(spark), spark.read.parquet(str(tmp_path / "r")), repeated_records(spark).withColumn("record_id", F.monotonically_increasing_id())):
        out = judging.judged_records(records, ask)
        assert out.columns == records.columns
        got = sorted((r.question_id or "", r.said, [c.extracted_answer for c in r.candidates], r.stats.correct) for r in out.collect())
        assert got == [("", "z", ["3"], 1), ("q", "x", ["....", "1"], 2), ("q", "y", ["2"], 1), ("q", "y", ["2"], 1)]
        scored = judging.scored_records(records, scorer.confidence_scores)
        got = sorted((r.question_id or "", r.said, [len(c.interval_scores) for c in r.candidates]) for r in scored.collect())
        assert got == [("", "z", [1]), ("q", "x", [1, 1]), ("q", "y", [1]), ("q", "y", [1])]
    fixed = judging.fix_records(repeated_records(spark))
    for mixed in (judging.with_verdicts(fixed, ask(judging.to_judge(fixed))), judging.with_scores(fixed, scorer.confidence_scores(judging.slices_of(fixed)))):
        with pytest.raises(Exception, match="record_id"):
            mixed.collect()


def test_identities_are_the_same_however_often_they_are_read(spark, tmp_path):
    from plumbline.sources.tables import identified

    spark.range(1000).withColumn("x", F.lit("same")).repartition(7).write.parquet(str(tmp_path / "t"))
    for df in (spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "t")).repartition(5)):
        one = identified(df)
        assert one.select("record_id").distinct().count() == 1000 and one.join(one.select("record_id", F.col("id").alias("other")), "record_id").where("id = other").count() == 1000


def test_fixing_a_table_without_candidates(spark):
    """Continuations are not candidates in this stage."""
    df = repeated_records(spark).withColumnRenamed("candidates", "continuations").drop("stats")
    fixed = judging.fix_records(df)
    assert {tuple(r.stats) for r in fixed.collect()} == {(0, 0, 0.0)} and "continuations" in fixed.columns
    assert judging.to_judge(fixed).count() == 0 and judging.with_verdicts(fixed, judging.to_judge(fixed).withColumn("reply", F.lit(""))).count() == 4
    assert judging.judged_records(df, lambda asked: asked.withColumn("reply", F.lit(""))).columns == [*df.columns, "stats"]


def test_questions_that_repeat_stay_records_of_their_own(spark):
    rows = [(i, "q", "p", "A", k, "\\boxed{A}", [0.1]) for i in (1, 2) for k in (0, 1)]
    df = sampling.judged(spark.createDataFrame(rows, "record_id long, question_id string, problem string, gold_answer string, pos int, text string, token_logprobs array<double>"))
    assert [len(r.candidates) for r in sampling.sampled_records(df).collect()] == [2, 2]
    assert [len(r.candidates) for r in sampling.sampled_records(df.drop("record_id")).collect()] == [4]


def test_a_stopped_run_goes_on(spark, tmp_path):
    """Rounds that were finished aren't worked on again; what a stopped round left behind goes."""
    from plumbline.sources import sinks

    path, kind = f"file://{tmp_path}/out", T.StructType().add("record_id", "string").add("x", "long").add("none", "string")
    src = str(tmp_path / "in")
    spark.range(100).repartition(3).write.parquet(src)
    worked = []

    def work(rows, stop=None):
        worked.append(rows.count())
        if len(worked) == stop:
            raise RuntimeError("stopped")
        return rows.select("record_id", (F.col("id") * 2).alias("x"), F.lit(None).cast("string").alias("none"))

    with pytest.raises(RuntimeError):
        sinks.resumed(spark.read.parquet(src), path, lambda r: work(r, 3), rounds=5)
    assert sinks.results(spark, path, kind).count() == sum(worked[:2]) < 100
    spark.range(3).selectExpr("'old' AS record_id", "id AS x", "'n' AS none").write.json(f"{path}/{sinks.PART}left")  # a round without its manifest
    spark.range(3).selectExpr("'old' AS record_id").write.parquet(f"{path}/{sinks.MANIFEST}broken")
    (tmp_path / "out" / f"{sinks.MANIFEST}broken" / "_SUCCESS").unlink()
    del worked[2:]
    assert sinks.resumed(spark.read.parquet(src), path, work, rounds=5) == 3 and sum(worked) == 100
    assert sorted(r.x for r in sinks.results(spark, path, kind).collect()) == list(range(0, 200, 2))
    assert sinks.resumed(spark.read.parquet(src), path, work, rounds=5) == 0
    assert not (tmp_path / "out" / f"{sinks.PART}left").exists()


def test_quarantine_over_splits_of_files(spark, tmp_path):
    """Row numbers count through splits; kept and rejected lines are all lines."""
    kind = T.StructType().add("a", "integer")
    lines = {"x.jsonl": [f'{{"a": {i}}}' if i % 3 else ["", "{bad", '{"a": "no"}'][i % 9 // 3] for i in range(400)], "y.jsonl": ['{"a": 1}', " ", "[1]"], "z.jsonl": []}
    for name, of in lines.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in of))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        kept, rejected = jsonl.quarantined(spark, str(tmp_path), kind)
        assert rejected.rdd.getNumPartitions() > 1
        bad = {(r.file.rsplit("/", 1)[1], r.row): (r.value, r.reason) for r in rejected.collect()}
        n = kept.count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    why = {"": "blank", " ": "blank", "{bad": "not JSON", '{"a": "no"}': "other types"}
    want = {(name, i): (x, why[x]) for name, of in lines.items() for i, x in enumerate(of) if x in why}
    assert {k: v for k, v in bad.items() if v[0] != "[1]"} == want
    assert n + len(bad) == sum(map(len, lines.values())) or ("y.jsonl", 2) not in bad


def test_counts_are_observed_in_the_pass_that_writes(spark, lines, tmp_path):
    """Blank and dropped lines are counted; the file is read once."""
    seen, counts = Observation(), Observation()
    reads = spark.sparkContext.accumulator(0)
    counted = spark.read.text(lines).mapInPandas(lambda frames: (reads.add(len(f)) or f for f in frames), "value string")
    fixed = judging.fix_records(jsonl.tolerant(counted, schemas.FIXED, seen=seen))
    jsonl.write_records(judging.observed(fixed, counts), str(tmp_path / "out"))
    assert seen.get == {"lines": 8, "blank": 1, "dropped": 2} and reads.value == 8
    assert counts.get == judging.run_counts(spark.read.schema(fixed.schema).json(str(tmp_path / "out"))).first().asDict()


def test_thresholds_are_refreshed_by_batches_of_a_stream(spark, tmp_path):
    """Sketches of batches, merged, are near the exact thresholds of what has arrived; in the end the stream's report is
    the batch's, though a batch was taken in twice."""
    from plumbline.operators import pruning
    from plumbline.streaming import refresh

    src, folder = tmp_path / "stream", f"file://{tmp_path}/state"
    src.mkdir()
    state = refresh.StreamedSelection(spark, folder)
    assert state.report() is None and tuple(state.limits().first()) == (10000, 10000)
    config = schemas.SelectionConfig()
    for n in range(3):
        rows = [json.dumps({**record(f"q{n}-{i}", ["A", "B", "A", "C"], scores=[100, 0, 50, 100]), "candidates": [{"extracted_answer": a, "is_correct": False, "interval_scores": [s], "token_logprobs": [-0.01 * ((k * (i + j + n + 3)) % 97) for k in range(60)]} for j, (a, s) in enumerate(zip("ABAC", [100, 0, 50, 100]))]}) for i in range(40)]
        (src / f"{n}.jsonl").write_text("\n".join([*rows, "{bad"]))
        q = apply.scored_stream(spark, str(src)).writeStream.foreachBatch(state.update).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()
        so_far = selection.jitters(selection.features(jsonl.read_scored(spark, str(src))))
        near, ordered = state.limits().first(), sorted(r.jitter for r in so_far.collect())
        for t, point in ((near.t_hi, 0.9), (near.t_lo, 0.1)):
            below, upto = sum(x < t for x in ordered) / len(ordered), sum(x <= t for x in ordered) / len(ordered)
            assert below <= point + 0.01 and upto >= point - 0.01
        # A sketch of so few values has them all; its quantile is one of them, next to the exact one or equal to one that is.
        for t, x in zip((near.t_hi, near.t_lo), pruning.exact_thresholds(so_far, "jitter", config.v100_jitter, config.v0_jitter).first()):
            near_it = sorted(set(ordered) | {x}).index(x)
            assert t in ordered and abs(sorted(set(ordered) | {x}).index(t) - near_it) <= 2
    state.update(jsonl.read_scored(spark, str(src / "2.jsonl")), 2)
    ids = lambda df: sorted(map(str, df.collect()))
    assert ids(state.report()) == ids(selection.report(jsonl.read_scored(spark, str(src))))
    assert state.report(exact=False).count() == 120
