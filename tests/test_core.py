"""Operators of the selection engine on small frames; expected values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.functions import arrays, text
from plumbline.operators import pruning, sampling, voting


def one(spark, column, value, kind):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "probs, block, want",
    [
        ([0.1, 0.3, 0.5, 0.7, 0.9, 0.9, 0.2], 2, 0.35),
        ([0.1, 0.1, 0.2, 0.2, 0.4, 0.4, 0.7, 0.7, 0.3, 0.3], 2, 0.25),
        ([0.5] * 19, 20, 0.0),
        ([0.5] * 20 + [0.9], 20, 0.0),
        ([0.5] * 20 + [0.9, 0.9], 20, 0.4),
        ([], 20, 0.0),
        ([0.3] * 500, 20, 0.0),
    ],
)
def test_jitter(spark, probs, block, want):
    assert one(spark, lambda c: arrays.jitter(c, block), probs, "array<double>") == pytest.approx(want, abs=1e-12)


def test_token_probabilities(spark):
    got = one(spark, arrays.token_probabilities, [None, -100.0, -100.5, float("nan"), -1.0, float("-inf")], "array<double>")
    assert got == [pytest.approx(math.exp(-1))]
    assert one(spark, arrays.token_probabilities, None, "array<double>") == []


@pytest.mark.parametrize("v100, v0, want", [(10, 90, (0.8, 0.15)), (0, -5, (10000, 10000)), (200, 100, (0.1, 0.1))])
def test_thresholds(spark, v100, v0, want):
    df = spark.createDataFrame([(x,) for x in (0.1, 0.5, 0.2, 0.9, 0.33, 0.7)], "j double")
    for f in (pruning.thresholds, pruning.exact_thresholds):
        assert tuple(f(df, "j", v100, v0).first()) == pytest.approx(want)
        assert tuple(f(df.where("false"), "j", 10, 90).first()) == (10000, 10000)


def test_ranks_by_brackets(spark):
    values = [float((i * 37) % 101) for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranks = [0, 1, 17, 500, 501, 998, 999]
    assert pruning.ranked(df, ranks, 1000, small=20) == [sorted(values)[k] for k in ranks]
    # Brackets that miss their ranks cost another pass and no result.
    assert pruning.ranked(df, ranks, 1000, 20, [(50.0, 50.5), (100.0, 200.0)]) == [sorted(values)[k] for k in ranks]


INF = float("inf")


@pytest.mark.parametrize(
    "values",
    [
        [float(i) for i in range(50)] + [INF] * 2,
        [-INF] * 3 + [float(i) for i in range(40)] + [INF] * 30,
        [1.0] * 60 + [math.nextafter(1.0, 2.0)] * 60,
        [0.0, -0.0] * 40,
        [INF] * 70,
        [7.5],
        [1e308, -1e308] * 30,
    ],
)
def test_percentiles_of_ties_and_infinities(spark, values):
    """Whatever the values, one rule: by brackets, by sorting and by Spark's aggregate."""
    points = [0.0, 0.03, 0.1, 0.5, 0.97, 1.0]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(3)
    ordered = sorted(values)
    at = [p * (len(values) - 1) for p in points]
    want = [pruning.between(ordered[int(x)], ordered[min(int(x) + 1, len(values) - 1)], x - int(x)) for x in at]
    alike = lambda got: all(a == b or (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b) for a, b in zip(got, want))
    assert alike(pruning.percentiles(df, "v", points, small=1)) and alike(pruning.percentiles(df, "v", points))
    if all(abs(v) < 1e300 for v in values) or values[0] >= 0:
        assert alike(df.agg(F.percentile("v", F.array(*map(F.lit, points)))).first()[0])
    nan = df.union(spark.createDataFrame([(float("nan"),)], "v double"))
    assert all(math.isnan(x) for x in pruning.percentiles(nan, "v", points, small=1))


def test_percentiles_pass_twice_over_the_values(spark, tmp_path):
    """Two jobs read the table, with five points as with one."""
    spark.range(20_000).selectExpr("cast((id * 7919) % 20011 as double) AS v").write.parquet(str(tmp_path / "v"))

    def reads(points):
        spark.sparkContext.setJobGroup(f"percentiles-{len(points)}", "")
        seen = spark.sparkContext.accumulator(0)
        df = spark.read.parquet(str(tmp_path / "v"))
        counted = df.mapInPandas(lambda frames: (seen.add(len(f)) or f for f in frames), "v double")
        pruning.percentiles(counted, "v", points, small=100)
        return seen.value

    assert reads([0.5]) == reads([0.01, 0.2, 0.5, 0.9, 0.99]) == 40_000


def test_long_pools_keep_their_columns(spark):
    """Columns that internal names might take stay, null keys are a key, and a hot key needs no window."""
    rows = spark.createDataFrame([("q", 1, 10.0, 0.5, 1, 2, 3.0), ("q", 2, 100.0, 0.1, 1, 2, 3.0), ("r", 1, 5.0, 0.9, 1, 2, 3.0), (None, 1, 5.0, 0.9, 1, 2, 3.0), (None, 2, 100.0, 0.9, 1, 2, 3.0)], "question_id string, pos int, score double, jitter double, stays int, some int, t_hi double")
    limits = spark.createDataFrame([(0.8, 0.6)], "t_hi double, t_lo double")
    high = pruning.high_or_all_long(rows, 100)
    assert high.columns == rows.columns and sorted(((r.question_id or "", r.pos) for r in high.collect())) == [("", 2), ("q", 2), ("r", 1)]
    left = pruning.veto_or_all_long(rows, 100, limits)
    assert left.columns == rows.columns and sorted(((r.question_id or "", r.pos, r.t_hi) for r in left.collect())) == [("", 1, 3.0), ("q", 2, 3.0), ("r", 1, 3.0)]
    assert "Window" not in left._jdf.queryExecution().executedPlan().toString()


POOL = "array<struct<ans:string,ok:boolean>>"


@pytest.mark.parametrize(
    "gold, answers, want",
    [
        ("A", ["B", "A", "A", "B"], ("B", 0.5, False)),
        ("5", ["5.0", "5.0", "5"], ("5.0", 2 / 3, False)),
        ("7", [None, None, "7"], ("INVALID", 2 / 3, False)),
        ("7", ["*", None, "7"], ("7", 2 / 3, True)),
        ("", ["*", None], ("INVALID", 1.0, True)),
        ("x", [], ("", 0.0, False)),
    ],
)
def test_votes(spark, gold, answers, want):
    rows = [(gold, [((None if a == "*" else a), a == "*") for a in answers])]
    df = spark.createDataFrame(rows, "gold string, c array<struct<answer:string,flag:boolean>>")
    g = text.normalize_veto(F.col("gold"))

    def ballot(x):
        raw = text.normalize_veto(x["answer"])
        return F.struct(voting.ballot(raw, x["flag"], g).alias("ans"), voting.effective(x["flag"], raw, g).alias("ok"))

    v = df.select(F.transform("c", ballot).alias("pool"), g.alias("g")).select(voting.vote_array(F.col("pool"), F.col("g")).alias("v")).first()["v"]
    assert (v.answer, v.confidence, v.is_correct) == (want[0], pytest.approx(want[1]), want[2])


@pytest.mark.parametrize(
    "pool, stage1, final",
    [
        ([(100, 0.2), (100, 0.4), (0, 0.2)], [0, 1], [0]),
        ([(100, 0.4), (100, 0.5)], [0, 1], [0, 1]),
        ([(0, 0.05), (50, 0.2)], [0, 1], [1]),
        ([(100, 0.3)], [0], [0]),
        ([(100, float("nan")), (100, 0.9)], [0, 1], [0]),
    ],
)
def test_pruning_both_ways(spark, pool, stage1, final):
    rows = [(1, i, float(s), j) for i, (s, j) in enumerate(pool)]
    long = spark.createDataFrame(rows, "question_id long, pos long, score double, jitter double")
    limits = spark.createDataFrame([(0.3, 0.1)], "t_hi double, t_lo double")
    high = pruning.high_or_all_long(long, 100)
    assert sorted(r.pos for r in high.collect()) == stage1
    assert sorted(r.pos for r in pruning.veto_or_all_long(high, 100, limits).collect()) == final
    nested = long.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", "score", "jitter"))).alias("p"))
    nested = nested.withColumn("h", pruning.high_or_all(F.col("p"), 100)).withColumn("k", pruning.veto_or_all(F.col("h"), 100, F.lit(0.3), F.lit(0.1)))
    r = nested.first()
    assert [x.pos for x in r.h] == stage1 and [x.pos for x in r.k] == final


NORMAL = [
    (None, "", "", "", ""),
    (" $1,000 ", "1,000", "1,000", "1000", "1,000"),
    ("$$5", "5", "5", "5", "$5"),
    ("5.", "5.0", "5.", "5.0", "5.0"),
    ("007", "7", "007", "7", "7"),
    ("b", "b", "B", "b", "b"),
    ("1e5", "1e5", "1E5", "1e5", "1e5"),
    (".5", "0.5", ".5", "0.5", "0.5"),
    ("+5", "5", "+5", "5", "5"),
    ("-0", "0", "-0", "0", "0"),
    ("1.5e3", "1500.0", "1.5E3", "1500.0", "1500.0"),
    ("1_000", "1000", "1_000", "1000", "1000"),
    ("12345678.5", "12345678.5", "12345678.5", "12345678.5", "12345678.5"),
    ("0.00001", "1e-05", "0.00001", "1e-05", "1e-05"),
    ("0.0001", "0.0001", "0.0001", "0.0001", "0.0001"),
    ("15000000000000000.", "1.5e+16", "15000000000000000.", "1.5e+16", "1.5e+16"),
    ("-123456789012345678901234567890", "-123456789012345678901234567890", "-123456789012345678901234567890", "-123456789012345678901234567890", "-123456789012345678901234567890"),
    ("  7\n", "7", "7", "7", "7"),
    ("1.5f", "1.5f", "1.5F", "1.5f", "1.5f"),
    ("1.0e300", "1e+300", "1.0E300", "1e+300", "1e+300"),
    ("a b", "ab", "AB", "ab", "ab"),
]


@pytest.mark.parametrize("k, f", list(enumerate([text.normalize_build, text.normalize_vl, text.normalize_fix, text.normalize_veto], 1)))
def test_normalised_answers(spark, k, f):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(NORMAL)], "i int, a string")
    got = [r.y for r in df.select("i", f(F.col("a")).alias("y")).orderBy("i").collect()]
    assert got == [r[k] for r in NORMAL]


EXTRACT = [
    # text, build GPQ, build MATH, fix GPQ, fix MATH
    (r"\boxed{\text{D. ~ 33.4}}", None, "33.4", "D", "33.4"),
    (r"\boxed{A. d}", "A", None, "D", None),
    (r"\boxed{33.4}", None, "33.4", None, "33.4"),
    (r"x \boxed{A} then \boxed{B}", "B", None, "B", None),
    ("The answer is (C)", "C", None, "C", None),
    ("", None, None, None, None),
    (None, None, None, None, None),
    (r"\boxed{{nested {B}} 7}", "B", "7", "B", "7"),
    (r"\boxed{open A", None, None, "A", None),
    ("#### 42\nmore A", None, "42", "A", "42"),
    ("I think 5", "I", "5", "I", "5"),
    ("answers to\n b", "S", None, "B", None),  # the guide word inside "answers" leaves "s to"
    ("it is -5", None, "5", None, "5"),
    ("it is -5.5", None, "-5.5", None, "-5.5"),
    ("3. done", None, "3", None, "3"),
    ("Option B\n", "B", None, "B", None),
    ("normal form", None, None, None, None),
]


def test_extraction(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(EXTRACT)], "i int, t string")
    c = F.col("t")
    got = df.select("i", text.extract_build(c, "GPQ").alias("a"), text.extract_build(c, "MATH").alias("b"), text.extract_fix(c, "GPQ").alias("c"), text.extract_fix(c, "MATH").alias("d"), text.extract_vl(c).alias("e")).orderBy("i").collect()
    for r, want in zip(got, EXTRACT):
        assert (r.a, r.b, r.c, r.d, r.e) == (*want[1:], want[1]), want[0]


@pytest.mark.parametrize(
    "reply, score",
    [("**Confidence: 85.5%**", 85), ("confidence 250", 100), ("Confidence: [90]%", 0), ("<think>Confidence: 10</think>Confidence: 70%", 70), ("no number", 0), ("<think>open Confidence: 3", 3), ("Confidence: 00099999999999999", 100), (None, 0)],
)
def test_confidence(spark, reply, score):
    assert one(spark, text.confidence, reply, "string") == score


@pytest.mark.parametrize(
    "value, want",
    [
        ("aa\n\nbbbb\n\ncc", ["aa\n\nbbbb\n\ncc", "aa\n\nbbbb"]),
        ("one step", ["one step"]),
        ("  \n\n ", [""]),
        ("a\n\n\n\nb", ["a\n\nb", "a"]),
        ("x<|im_end|>", ["x"]),
    ],
)
def test_interval_slices(spark, value, want):
    assert one(spark, lambda c: arrays.interval_slices(c, 2), value, "string") == want


def test_interval_slices_with_prefix(spark):
    got = one(spark, lambda c: arrays.interval_slices(c, 2, prefix=F.lit(" Pre ")), "Pre aaaa\n\nb", "string")
    assert got == ["Pre\naaaa\n\nb", "Pre\naaaa"]


def test_until_eos(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [5, 9, 9]), ([1.0], [5])], "v array<double>, i array<int>")
    assert [r[0] for r in df.select(arrays.until_eos(F.col("v"), F.col("i"), 9)).collect()] == [[1.0, 2.0], [1.0]]


def test_slices_reject_negative_bounds():
    with pytest.raises(ValueError):
        schemas.SelectionConfig(sample_s=-1)


def test_aliases_follow_presence(spark):
    df = spark.createDataFrame([("", "p", None)], "problem string, prompt string, answer string")
    r = df.select(schemas.question_of(df).alias("q"), schemas.gold_of(df).alias("g"), schemas.id_of(df).alias("i")).first()
    assert (r.q, r.g) == ("p", "None") and r.i


def test_hash_sample_ignores_order(spark):
    df = spark.range(500)
    a = {r.id for r in sampling.hash_sample(df, "id", 20).collect()}
    assert a == {r.id for r in sampling.hash_sample(df.orderBy(F.desc("id")).repartition(7), "id", 20).collect()} and len(a) == 20
    assert sampling.hash_sample(df, "id", -1).count() == 500
