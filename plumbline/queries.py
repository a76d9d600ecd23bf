"""The query catalogue: each query on the test tables, and DuckDB SQL with the same result.

The tables hold no model output, so queries make their records from columns: sixteen vectors
are a question's candidates, components are log-probabilities, labels are answers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schemas
from plumbline.functions import arrays, sql as sql_functions, text
from plumbline.operators import prompts, pruning, sampling, voting
from plumbline.plans import judging, sampling as sampled, segments, selection
from plumbline.sources import images, jsonl, replies, scorer, sinks
from plumbline.sources.tables import materialised, run_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


# Records made of embeddings ------------------------------------------------------------------


def candidates(spark, sf_dir, probs: bool = True) -> DataFrame:
    """Long candidates: question_id, pos, answer, gold, flag, score, logprobs."""
    e = table(spark, sf_dir, "embeddings")
    lp = F.transform("embedding", lambda x, i: F.when(i % 13 == 5, F.lit(None)).when(i % 17 == 3, F.lit(-200.0)).otherwise(-F.abs(x.cast("double"))))
    q = F.floor(F.col("vec_id") / 16)
    return e.select(
        q.alias("question_id"),
        (F.col("vec_id") % 16).alias("pos"),
        F.when(F.col("vec_id") % 7 != 0, F.col("label").cast("string")).alias("answer"),
        (q % 10).cast("string").alias("gold"),
        (F.col("vec_id") % 11 == 0).alias("flag"),
        F.when((F.col("vec_id") % 3 == 0) & (q % 2 == 0), 100).otherwise(F.col("vec_id") % 100).cast("double").alias("score"),
        *([lp.alias("logprobs")] if probs else []),
    )


def records(spark, sf_dir) -> DataFrame:
    """Scored records of the candidates."""
    c = F.struct(
        "pos",
        F.col("answer").alias("extracted_answer"),
        F.col("flag").alias("is_correct"),
        F.col("logprobs").alias("token_logprobs"),
        F.array("score").alias("interval_scores"),
    )
    g = candidates(spark, sf_dir).groupBy("question_id", "gold").agg(F.sort_array(F.collect_list(c)).alias("candidates"))
    return g.withColumnRenamed("gold", "gold_answer")


def long_features(spark, sf_dir, block: int = 20) -> DataFrame:
    """Long candidates with ans (ballot), ok and jitter."""
    c = candidates(spark, sf_dir).withColumn("jitter", arrays.jitter(arrays.token_probabilities(F.col("logprobs")), block)).drop("logprobs")
    raw = text.normalize_veto(F.col("answer"))
    return c.withColumn("ok", voting.effective(F.col("flag"), raw, F.col("gold"))).withColumn("ans", voting.ballot(raw, F.col("flag"), F.col("gold")))


CAND = """
cand AS (
  SELECT vec_id // 16 AS question_id, vec_id % 16 AS pos, CASE WHEN vec_id % 7 <> 0 THEN CAST(label AS VARCHAR) ELSE '' END AS raw,
    CAST((vec_id // 16) % 10 AS VARCHAR) AS gold, vec_id % 11 = 0 AS flag,
    CASE WHEN vec_id % 3 = 0 AND (vec_id // 16) % 2 = 0 THEN 100 ELSE vec_id % 100 END AS score,
    list_transform(list_filter(list_transform(embedding, lambda x, i: CASE WHEN (i - 1) % 13 = 5 THEN NULL WHEN (i - 1) % 17 = 3 THEN -200.0 ELSE -abs(CAST(x AS DOUBLE)) END),
      lambda x: x IS NOT NULL AND x > -100), lambda x: exp(x)) AS p
  FROM embeddings),
ballots AS (SELECT *, flag OR (gold <> '' AND raw = gold) AS ok, CASE WHEN raw <> '' THEN raw WHEN flag AND gold <> '' THEN gold ELSE 'INVALID' END AS ans FROM cand)"""


def jitter_cte(block: int, name: str = "feat") -> str:
    return f"""
means AS (SELECT * EXCLUDE (p), len(p) AS n, list_transform(range(0, len(p) // {block} + CASE WHEN len(p) % {block} >= 2 THEN 1 ELSE 0 END),
  lambda b: list_avg(p[b * {block} + 1 : b * {block} + {block}])) AS m FROM ballots),
diffs AS (SELECT * EXCLUDE (m), CASE WHEN n >= {block} AND len(m) >= 2 THEN list_sort(list_transform(range(1, len(m)), lambda i: abs(m[i + 1] - m[i]))) ELSE CAST([] AS DOUBLE[]) END AS d FROM means),
{name} AS (SELECT * EXCLUDE (d, n), coalesce(list_avg(CASE WHEN floor(len(d) * 0.25) > 0 THEN d[CAST(floor(len(d) * 0.25) AS INT) + 1 : CAST(floor(len(d) * 0.75) AS INT)] ELSE d END), 0.0) AS jitter FROM diffs)"""


LIMITS = "limits AS (SELECT quantile_cont(jitter, 0.9) AS t_hi, quantile_cont(jitter, 0.1) AS t_lo FROM feat)"
POOLS = """
stage1 AS (SELECT * FROM feat QUALIFY score >= 100 OR count(*) FILTER (WHERE score >= 100) OVER (PARTITION BY question_id) = 0),
kept AS (SELECT * FROM (SELECT stage1.*, CASE WHEN score >= 100 THEN NOT jitter > t_hi ELSE NOT jitter < t_lo END AS stays FROM stage1, limits)
  QUALIFY stays OR count(*) FILTER (WHERE stays) OVER (PARTITION BY question_id) = 0)"""


def vote_cte(name: str, pool: str) -> str:
    return f"""
{name}_n AS (SELECT question_id, ans, count(*) AS n, min(pos) AS first_pos, bool_or(ok) AS any_ok, any_value(gold) AS gold FROM {pool} GROUP BY question_id, ans),
{name} AS (SELECT question_id, ans, n, n / sum(n) OVER (PARTITION BY question_id) AS confidence, (gold <> '' AND ans = gold) OR any_ok AS is_correct FROM {name}_n
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY n DESC, first_pos) = 1)"""


# Votes ---------------------------------------------------------------------------------------

_VOTE = """
SELECT question_id, answer, votes, CAST(pool_size AS BIGINT) AS pool_size, round(votes / pool_size, 6) AS confidence FROM (
  SELECT question_id, answer, n AS votes, sum(n) OVER (PARTITION BY question_id) AS pool_size, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, first_pos) AS rn
  FROM (SELECT question_id, answer, count(*) AS n, min(pos) AS first_pos FROM rows_ GROUP BY ALL)) WHERE rn = 1"""


@query("WITH rows_ AS (SELECT vec_id // 16 AS question_id, vec_id % 16 AS pos, CAST(label AS VARCHAR) AS answer FROM embeddings)" + _VOTE)
def vote_majority(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("question_id"), (F.col("vec_id") % 16).alias("pos"), F.col("label").cast("string").alias("answer"))
    return voting.vote_long(e).withColumn("confidence", r6("confidence"))


@query("WITH rows_ AS (SELECT user_id AS question_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS answer FROM events)" + _VOTE)
def vote_ties_events(spark, sf_dir):
    # The first row of each answer, by time, stands for its position: no window over a user's rows.
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id"), F.col("event_type").alias("answer"), F.struct("ts", "event_id").alias("pos"))
    counts = e.groupBy("question_id", "answer").agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"))
    lists = counts.groupBy("question_id").agg(F.sum("votes").alias("pool_size"), F.max("votes").alias("most"), F.collect_list(F.struct("first", "answer", "votes")).alias("c"))
    best = F.array_min(F.filter("c", lambda x: x["votes"] == F.col("most")))  # a few answers for each question
    return lists.select("question_id", best["answer"].alias("answer"), F.col("most").alias("votes"), "pool_size", r6(F.col("most") / F.col("pool_size")).alias("confidence"))


@query(f"WITH {CAND}, {vote_cte('won', 'ballots')} SELECT question_id, ans AS answer, round(confidence, 6) AS confidence, is_correct FROM won")
def vote_invalid_bucket(spark, sf_dir):
    pools = selection.features(records(spark, sf_dir))
    v = pools.select("question_id", voting.vote_array(F.col("pool"), F.col("gold")).alias("v"))
    return v.select("question_id", "v.answer", r6("v.confidence").alias("confidence"), "v.is_correct")


@query(
    f"""WITH {CAND}, {vote_cte('won', 'ballots')}
SELECT b.question_id, count(*) AS cluster_size, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions, count(*) FILTER (WHERE ok) AS correct
FROM ballots b JOIN won USING (question_id) WHERE b.ans = won.ans GROUP BY b.question_id"""
)
def winning_cluster(spark, sf_dir):
    rows = voting.clusters_long(long_features(spark, sf_dir))
    return rows.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("cluster_size"),
        F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda x: x.cast("string")), ",").alias("positions"),
        F.count_if("ok").alias("correct"),
    )


# Jitter --------------------------------------------------------------------------------------


def _jitter(block: int):
    def f(spark, sf_dir):
        return long_features(spark, sf_dir, block).select("question_id", "pos", r6("jitter").alias("jitter"))

    f.__name__ = f"jitter_b{block}"
    return query(f"WITH {CAND}, {jitter_cte(block)} SELECT question_id, pos, round(jitter, 6) AS jitter FROM feat")(f)


for _b in (4, 10, 20):
    _jitter(_b)


@query(SQL["jitter_b10"])
def jitter_long_form(spark, sf_dir):
    """The same measure over one row per token, with windows."""
    from pyspark.sql import Window as W

    c = candidates(spark, sf_dir).withColumn("p", arrays.token_probabilities(F.col("logprobs")))
    tokens = c.select("question_id", "pos", F.posexplode("p").alias("i", "x"))
    blocks = tokens.groupBy("question_id", "pos", F.floor(F.col("i") / 10).alias("b")).agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    key = W.partitionBy("question_id", "pos")
    d = blocks.withColumn("d", F.abs(F.col("m") - F.lag("m").over(key.orderBy("b")))).where("d is not null")
    d = d.withColumn("r", F.row_number().over(key.orderBy("d")) - 1).withColumn("k", F.count(F.lit(1)).over(key))
    a, b = F.floor(F.col("k") * 0.25), F.floor(F.col("k") * 0.75)
    mean = d.where((a == 0) | ((F.col("r") >= a) & (F.col("r") < b))).groupBy("question_id", "pos").agg(F.avg("d").alias("jitter"))
    # Fewer tokens than a block is 0, as are fewer than two blocks.
    short = c.select("question_id", "pos", (F.size("p") < 10).alias("short"))
    return short.join(mean, ["question_id", "pos"], "left").select("question_id", "pos", r6(F.when(F.col("short"), 0.0).otherwise(F.coalesce("jitter", F.lit(0.0)))).alias("jitter"))


@query(f"WITH {CAND}, {jitter_cte(20)}, {LIMITS} SELECT round(t_hi, 6) AS t_hi, round(t_lo, 6) AS t_lo FROM limits")
def jitter_thresholds(spark, sf_dir):
    t = pruning.thresholds(long_features(spark, sf_dir), "jitter", 10, 90)
    return t.select(r6("t_hi").alias("t_hi"), r6("t_lo").alias("t_lo"))


@query("SELECT CAST(10000 AS DOUBLE) AS t_hi, CAST(10000 AS DOUBLE) AS t_lo")
def jitter_thresholds_disabled(spark, sf_dir):
    return pruning.thresholds(long_features(spark, sf_dir), "jitter", 0, -1)


@query(SQL["jitter_thresholds"])
def jitter_thresholds_exact(spark, sf_dir):
    """The percentiles by narrowing ranks instead of one aggregate."""
    t = pruning.exact_thresholds(long_features(spark, sf_dir), "jitter", 10, 90)
    return t.select(r6("t_hi").alias("t_hi"), r6("t_lo").alias("t_lo"))


# Pruning and the report ----------------------------------------------------------------------


@query(f"WITH {CAND}, {jitter_cte(20)}, {LIMITS}, {POOLS} SELECT question_id, pos, CAST(score AS DOUBLE) AS score FROM stage1")
def score_filter_fallback(spark, sf_dir):
    return pruning.high_or_all_long(candidates(spark, sf_dir, probs=False), 100).select("question_id", "pos", "score")


@query(f"WITH {CAND}, {jitter_cte(20)}, {LIMITS}, {POOLS} SELECT question_id, pos, CAST(score AS DOUBLE) AS score, round(jitter, 6) AS jitter FROM kept")
def jitter_veto(spark, sf_dir):
    rows = materialised(long_features(spark, sf_dir), "long-features")
    limits = pruning.exact_thresholds(rows, "jitter", 10, 90)
    kept = pruning.veto_or_all_long(pruning.high_or_all_long(rows, 100), 100, limits)
    return kept.select("question_id", "pos", "score", r6("jitter").alias("jitter"))


REPORT = f"""WITH {CAND}, {jitter_cte(20)}, {LIMITS}, {POOLS}, {vote_cte('base', 'feat')}, {vote_cte('final', 'kept')},
won AS (SELECT k.question_id, count(*) AS pool_size, string_agg(CAST(CAST(score AS INTEGER) AS VARCHAR), ',' ORDER BY pos) AS current_score,
  string_agg(CASE WHEN ok THEN 'true' ELSE 'false' END, ',' ORDER BY pos) AS current_corrrect, bool_or(ok) AS any_ok FROM kept k JOIN final f ON k.question_id = f.question_id AND k.ans = f.ans GROUP BY k.question_id),
whole AS (SELECT x.question_id, count(*) AS n, bool_or(ok) AS any_ok, count(*) FILTER (WHERE x.ans = f.ans) / count(*) AS ratio FROM feat x JOIN final f ON x.question_id = f.question_id GROUP BY x.question_id)"""


@query(
    REPORT
    + """
SELECT f.question_id, f.is_correct, 'JITTER' AS strategy, f.ans = b.ans AS is_same_as_base, round(whole.ratio, 6) AS final_ans_original_ratio, CAST(won.pool_size AS INTEGER) AS pool_size,
  round(b.confidence, 6) AS baseline_confidence, round(f.confidence, 6) AS final_confidence, 0 AS total_tokens, 'final verbalize' AS stop_reason, won.current_score, won.current_corrrect
FROM final f JOIN base b USING (question_id) JOIN won USING (question_id) JOIN whole USING (question_id)"""
)
def selection_report(spark, sf_dir):
    return _shown(selection.report(records(spark, sf_dir), large=False))


def _shown(out: DataFrame) -> DataFrame:
    """Rounded doubles, and arrays as text."""
    for c in ("final_ans_original_ratio", "baseline_confidence", "final_confidence"):
        out = out.withColumn(c, r6(c))
    out = out.withColumn("current_score", F.array_join(F.transform("current_score", lambda x: x.cast("int").cast("string")), ","))
    return out.withColumn("current_corrrect", F.array_join(F.transform("current_corrrect", lambda x: x.cast("string")), ","))


@query(SQL["selection_report"])
def selection_report_large(spark, sf_dir):
    """The report with features written once and percentiles by narrowing."""
    return _shown(selection.report(records(spark, sf_dir)))


@query(
    REPORT
    + """
SELECT 'baseline' AS run, round(100 * avg(CAST(b.is_correct AS INT)), 6) AS accuracy, round(100 * avg(CAST(whole.any_ok AS INT)), 6) AS oracle, round(avg(whole.n), 6) AS mean_pool_size FROM base b JOIN whole USING (question_id)
UNION ALL
SELECT 'final', round(100 * avg(CAST(f.is_correct AS INT)), 6), round(100 * avg(CAST(won.any_ok AS INT)), 6), round(avg(won.pool_size), 6) FROM final f JOIN won USING (question_id)"""
)
def selection_metrics(spark, sf_dir):
    m = selection.metrics(selection.selected(selection.features(records(spark, sf_dir))))
    return m.select("run", *[r6(c).alias(c) for c in ("accuracy", "oracle", "mean_pool_size")])


@query("SELECT vec_id // 16 AS question_id, count(*) AS n, string_agg(CAST(label AS VARCHAR), ',' ORDER BY vec_id) AS answers FROM embeddings WHERE vec_id % 16 BETWEEN 3 AND 8 GROUP BY 1")
def sample_slice(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    g = e.groupBy(F.floor(F.col("vec_id") / 16).alias("question_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "label"))), lambda x: x["label"].cast("string")).alias("c"))
    g = g.withColumn("c", arrays.python_slice(F.col("c"), 3, 9)).where("size(c) > 0")
    return g.select("question_id", F.size("c").cast("long").alias("n"), F.array_join("c", ",").alias("answers"))


@query(f"WITH {CAND} SELECT question_id, CAST(count(*) AS INTEGER) AS total, CAST(count(*) FILTER (WHERE flag) AS INTEGER) AS correct, round(count(*) FILTER (WHERE flag) / count(*), 6) AS accuracy FROM cand GROUP BY question_id")
def record_stats(spark, sf_dir):
    s = records(spark, sf_dir).select("question_id", voting.record_stats(F.col("candidates")).alias("s"))
    return s.select("question_id", "s.total", "s.correct", r6("s.accuracy").alias("accuracy"))


# Text ----------------------------------------------------------------------------------------

#: Answers made of parts: signs, spaces, thousands, dots, zeros, letters.
_ANSWERS = """CASE p_partkey % 8 WHEN 0 THEN ' $' || p_size || ',000 ' WHEN 1 THEN '$$' || p_size WHEN 2 THEN p_size || '.' WHEN 3 THEN '00' || p_size
  WHEN 4 THEN ' ' || chr(97 + p_size % 26) || ' ' WHEN 5 THEN p_size || 'e5' WHEN 6 THEN '-' || p_size || '.50' ELSE NULL END"""
_NUMERIC = """CASE WHEN regexp_full_match(x, '[+-]?\\d+') THEN regexp_replace(CASE WHEN x LIKE '-%' THEN '-' ELSE '' END || regexp_replace(x, '^[+-]?0*(\\d)', '\\1'), '^-0$', '0')
  WHEN regexp_full_match(x, '[+-]?(\\d+\\.\\d*|\\.\\d+)') THEN CAST(CAST(x AS DOUBLE) AS VARCHAR) ELSE x END"""


def _normalize(name: str, f, sql: str, numeric: bool = True):
    def run(spark, sf_dir):
        parts = table(spark, sf_dir, "part").select("p_partkey", F.expr(_ANSWERS.replace("chr(", "char(")).alias("a"))
        return parts.select("p_partkey", f(F.col("a")).alias("answer"))

    run.__name__ = name
    value = _NUMERIC if numeric else "x"
    return query(f"WITH a AS (SELECT p_partkey, coalesce({_ANSWERS}, '') AS a FROM part), b AS (SELECT p_partkey, {sql} AS x FROM a) SELECT p_partkey, {value} AS answer FROM b")(run)


_normalize("normalize_build", text.normalize_build, "replace(replace(trim(a), '$', ''), ' ', '')")
_normalize("normalize_vl", text.normalize_vl, "upper(replace(replace(trim(a), '$', ''), ' ', ''))", False)
_normalize("normalize_fix", text.normalize_fix, "replace(replace(replace(trim(a), ',', ''), '$', ''), ' ', '')")
_normalize("normalize_veto", text.normalize_veto, "regexp_replace(replace(trim(a), ' ', ''), '^\\$', '')")


@query(
    """SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS INTEGER) = CAST(l_discount * 100 AS INTEGER) AS same_build,
  ('Q' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) = ('Q' || CAST(l_linenumber AS VARCHAR)) AS same_vl FROM lineitem"""
)
def check_correctness(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    q, d = F.col("l_quantity").cast("int").cast("string"), F.round(F.col("l_discount") * 100).cast("int").cast("string")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        text.correct(F.concat(F.lit(" $0"), q), F.concat(d, F.lit(" ")), text.normalize_build).alias("same_build"),
        text.correct(F.concat(F.lit("q"), q), F.concat(F.lit(" Q"), F.col("l_linenumber").cast("string")), text.normalize_vl).alias("same_vl"),
    )


#: Texts with an answer behind them in one of several ways, the same on both sides.
_WITH_ANSWER = """CASE doc_id % 7
  WHEN 0 THEN text || ' \\boxed{' || chr(CAST(65 + doc_id % 5 AS INTEGER)) || '}'
  WHEN 1 THEN text || ' \\boxed{\\text{' || chr(CAST(65 + doc_id % 5 AS INTEGER)) || '. ~ ' || doc_id || '.5}} ok'
  WHEN 2 THEN text || ' #### ' || doc_id || ' '
  WHEN 3 THEN text || ' \\boxed{1} then \\boxed{{' || doc_id || '} units}'
  WHEN 4 THEN 'So. The answer is (' || chr(CAST(65 + doc_id % 5 AS INTEGER)) || ').'
  WHEN 5 THEN text || ' \\boxed{open'
  ELSE 'about -' || doc_id || ' and ' || doc_id || '.25%' END"""


def _answers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    letter = F.char(F.lit(65) + k % 5)
    n = k.cast("string")
    cases = [
        F.concat("text", F.lit(" \\boxed{"), letter, F.lit("}")),
        F.concat("text", F.lit(" \\boxed{\\text{"), letter, F.lit(". ~ "), n, F.lit(".5}} ok")),
        F.concat("text", F.lit(" #### "), n, F.lit(" ")),
        F.concat("text", F.lit(" \\boxed{1} then \\boxed{{"), n, F.lit("} units}")),
        F.concat(F.lit("So. The answer is ("), letter, F.lit(").")),
        F.concat("text", F.lit(" \\boxed{open")),
        F.concat(F.lit("about -"), n, F.lit(" and "), n, F.lit(".25%")),
    ]
    out = cases[6]
    for i in range(6):
        out = F.when(k % 7 == i, cases[i]).otherwise(out)
    return d.select("doc_id", out.alias("t"))


_T = f"t AS (SELECT doc_id, {_WITH_ANSWER} AS t FROM documents)"
# The box of these texts, by how they were made; the operator under test has to find it by scanning.
_BOX = """CASE doc_id % 7 WHEN 0 THEN chr(CAST(65 + doc_id % 5 AS INTEGER)) WHEN 1 THEN '\\text{' || chr(CAST(65 + doc_id % 5 AS INTEGER)) || '. ~ ' || doc_id || '.5}' WHEN 3 THEN '{' || doc_id || '} units' END"""
_TAIL = "trim(regexp_replace(t, '.*####', '', 's'))"
_GUIDE_SQL = r"nullif(trim(regexp_extract(t, '(?i)(?:The answer is|Final Answer[:\s]*|The correct option is[:\s]*|Answer[:\s]*)\s*([^\n]+)', 1)), '')"
_TARGET = f"x AS (SELECT doc_id, t, coalesce({_BOX}, CASE WHEN contains(t, '####') THEN {_TAIL} ELSE {_GUIDE_SQL} END, trim(t)) AS x FROM t)"
_OPTION = r"""coalesce(nullif(upper(regexp_extract(x, '(?i)[\(\[\{]([A-Z])[\)\]\}]', 1)), ''), nullif(upper(regexp_extract(x, '(?i)^(?:Option|Answer|Choice)?\s*([A-Z])(?:\.|:|\)|\s|$)', 1)), ''),
  CASE WHEN length(regexp_replace(upper(x), '[^A-Z]', '', 'g')) = 1 THEN regexp_replace(upper(x), '[^A-Z]', '', 'g') END)"""


@query(f"WITH {_T} SELECT doc_id, {_BOX} AS box FROM t")
def extract_boxed(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", text.boxed(F.col("t")).alias("box"))


@query(f"WITH {_T}, {_TARGET} SELECT doc_id, {_OPTION} AS answer FROM x")
def extract_gpq_build(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", text.extract_build(F.col("t"), "GPQ").alias("answer"))


@query(f"WITH {_T}, {_TARGET} SELECT doc_id, regexp_extract_all(translate(x, ',$\\%', ''), '[-+]?\\d*\\.\\d+|\\d+')[-1] AS answer FROM x")
def extract_math_build(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", text.extract_build(F.col("t"), "MATH").alias("answer"))


@query(SQL["extract_gpq_build"])
def extract_vl(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", text.extract_vl(F.col("t")).alias("answer"))


_CLEAN = f"coalesce({_BOX}, CASE WHEN contains(t, '####') THEN regexp_replace(t, '.*####', '', 's') ELSE right(trim(t), 100) END)"
_CLEAN = f"translate({_CLEAN}, '~\\$%{{}}', '      ')"
for _w in text.BOX_WORDS:
    _CLEAN = f"replace({_CLEAN}, '{_w}', ' ')"


@query(
    f"""WITH {_T}, c AS (SELECT doc_id, {_CLEAN} AS c FROM t),
w AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(upper(c), '\\s+'), lambda x: translate(x, '.:)(', '')), lambda x: regexp_full_match(x, '\\p{{L}}')) AS w FROM c)
SELECT doc_id, w[-1] AS answer FROM w"""
)
def extract_gpq_fix(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", text.extract_fix(F.col("t"), "GPQ").alias("answer"))


@query(f"WITH {_T}, c AS (SELECT doc_id, {_CLEAN} AS c FROM t) SELECT doc_id, regexp_extract_all(replace(c, ',', ''), '[-+]?\\d*\\.\\d+|\\d+')[-1] AS answer FROM c")
def extract_math_fix(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", text.extract_fix(F.col("t"), "MATH").alias("answer"))


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN chr(CAST(65 + doc_id % 5 AS INTEGER)) WHEN 1 THEN chr(CAST(65 + doc_id % 3 AS INTEGER)) ELSE NULL END AS answer,
  CASE doc_id % 4 WHEN 0 THEN doc_id % 5 = doc_id % 3 WHEN 1 THEN true ELSE false END AS is_correct FROM documents"""
)
def rejudge(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    c = F.struct(
        F.when(k % 4 == 0, F.concat(F.lit("so \\boxed{"), F.char(F.lit(65) + k % 5), F.lit("}"))).otherwise(F.lit("....")).alias("text"),
        F.when(k % 4 == 1, F.char(F.lit(65) + k % 3)).alias("extracted_answer"),
        F.lit(False).alias("is_correct"),
    )
    gold = F.when(k % 2 == 0, F.concat(F.lit("("), F.char(F.lit(65) + k % 3), F.lit(")"))).otherwise(F.char(F.lit(65) + k % 3))
    fixed = judging.fix_records(d.select(k.alias("question_id"), F.lit("").alias("problem"), gold.alias("gold_answer"), F.array(c).alias("candidates")))
    return fixed.select(F.col("question_id").alias("doc_id"), F.col("candidates")[0]["extracted_answer"].alias("answer"), F.col("candidates")[0]["is_correct"].alias("is_correct"))


@query(
    """SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') WHEN 1 THEN 'a  b' ELSE '<think>' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') END) AS stripped FROM documents"""
)
def think_strip(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    t = F.when(k % 3 == 0, F.concat(F.lit(" <think>one\ntwo</think>"), "text")).when(k % 3 == 1, F.concat(F.lit("a <think>"), "text", F.lit("</think> b"))).otherwise(F.concat(F.lit("<think>"), "text"))
    return d.select("doc_id", F.md5(F.encode(text.without_think(t), "UTF-8")).alias("stripped"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN least(n_chars % 150, 100) WHEN 2 THEN 7 ELSE 0 END::INTEGER AS score FROM documents")
def confidence_parse(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    n = (F.col("n_chars") % 150).cast("string")
    t = (
        F.when(k % 4 == 0, F.concat(F.lit("<think>Confidence: 9</think> nothing "), n))
        .when(k % 4 == 1, F.concat(F.lit("**Confidence: "), n, F.lit(".5%**")))
        .when(k % 4 == 2, F.concat(F.lit("CONFIDENCE :\n 7 Confidence: "), n))
        .otherwise(F.concat(F.lit("Confidence: ["), n, F.lit("]%")))
    )
    return d.select("doc_id", text.confidence(t).alias("score"))


@query(
    r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
s AS (SELECT doc_id, t, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS s FROM t),
n AS (SELECT *, len(s) AS n, list_sum(list_transform(s, lambda x: length(x))) + len(s) - 1 AS total FROM s),
c AS (SELECT *, list_transform(range(1, n + 1), lambda k: list_sum(list_transform(s[1:k], lambda x: length(x) + 1))) AS cum FROM n),
e AS (SELECT *, list_filter(range(1, n + 1), lambda k: cum[k] >= total / 10.0)[1] AS e FROM c)
SELECT doc_id, CASE WHEN n > 0 AND e < n THEN 2 ELSE 1 END AS n_slices, md5(CASE WHEN n = 0 THEN t ELSE array_to_string(s, chr(10)) END) AS full_slice,
  CASE WHEN n > 0 AND e < n THEN md5(array_to_string(s[1:e], chr(10))) END AS first_slice FROM e"""
)
def interval_slices(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s = d.select("doc_id", arrays.interval_slices(F.col("text"), 10, "\n").alias("s"))
    md5 = lambda c: F.md5(F.encode(c, "UTF-8"))
    return s.select("doc_id", F.size("s").alias("n_slices"), md5(F.col("s")[0]).alias("full_slice"), md5(F.try_element_at("s", F.lit(2))).alias("first_slice"))


# Aggregates, prompts, samples ----------------------------------------------------------------


@query(
    """WITH s AS (SELECT user_id AS question_id, event_type AS pos, CAST(floor(value) AS INTEGER) AS score FROM events)
SELECT question_id, CAST(sum(n) AS BIGINT) AS n_scores, min(least_score) AS min_verbal_score, round(avg(mean), 6) AS avg_confidence FROM (
  SELECT question_id, pos, count(*) AS n, min(score) AS least_score, avg(score) AS mean FROM s GROUP BY ALL) GROUP BY question_id"""
)
def verbal_aggregate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.select(F.col("user_id").alias("question_id"), F.col("event_type").alias("pos"), F.col("event_id").alias("slice_idx"), F.floor("value").cast("int").alias("score"))
    c = judging.candidate_scores(s)
    return c.groupBy("question_id").agg(F.sum(F.size("interval_scores")).alias("n_scores"), F.min("min_verbal_score").alias("min_verbal_score"), r6(F.avg("avg_verbal_score")).alias("avg_confidence"))


@query(
    """SELECT r_regionkey, 'Question: ' || any_value(r_name) || chr(10) || 'Options:' || chr(10) || string_agg(chr(65 + CAST(n_nationkey AS INTEGER) % 26) || '. ' || n_name, chr(10) ORDER BY n_nationkey) AS prompt
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey"""
)
def options_struct(spark, sf_dir):
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    label = F.transform("n", lambda x: F.char(F.lit(65) + x["n_nationkey"] % 26))
    options = F.struct(label.alias("label"), F.col("n.n_name").alias("text"))
    r = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    return r.select("r_regionkey", prompts.option_struct(F.col("r_name"), options).alias("prompt"))


@query(
    """WITH n AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)
SELECT n_regionkey, string_agg(chr(CAST(64 + i AS INTEGER)) || '. ' || n_name || chr(10), '' ORDER BY i) AS options FROM n GROUP BY n_regionkey"""
)
def options_list(spark, sf_dir):
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    literal = F.concat(F.lit("['"), F.array_join("n.n_name", "', '"), F.lit("']"))
    return n.select("n_regionkey", prompts.option_list(literal).alias("options"))


@query(f"SELECT doc_id, md5(coalesce(nullif(text, ''), lang, '') || chr(10) || chr(10) || '{prompts.SOLVE}') AS prompt FROM documents")
def prompt_build(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("question"), F.col("lang").alias("prompt"))
    return d.select("doc_id", F.md5(F.encode(prompts.prompt(schemas.question_of(d)), "UTF-8")).alias("prompt"))


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click'")
def mc_filter(spark, sf_dir):
    return sampling.only_if_present(sampling.only_if_present(table(spark, sf_dir, "events"), "event_type", "click"), "question_type", "none").select("event_id", "event_type")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 250")
def hash_sample(spark, sf_dir):
    return sampling.hash_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 250)


@query(
    """WITH i AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 100) AS BIGINT) % 20) AS ids FROM embeddings)
SELECT vec_id, CASE WHEN list_position(ids, 7) > 0 THEN list_position(ids, 7) ELSE len(ids) END AS n FROM i"""
)
def eos_truncate(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("ids", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 100) % 20))
    return e.select("vec_id", F.size(arrays.until_eos(F.col("embedding"), F.col("ids"), 7)).alias("n"))


@query(
    f"""WITH {CAND} SELECT question_id, count(*) AS n, string_agg(raw, ',' ORDER BY pos) AS answers, round(sum(list_sum(p)), 4) AS mass FROM cand GROUP BY question_id"""
)
def jsonl_tolerant(spark, sf_dir):
    """Records as JSON lines, among blank and broken ones, read back."""
    made = records(spark, sf_dir).withColumn("question_id", F.col("question_id").cast("string"))
    lines = made.select(F.to_json(F.struct("*")).alias("value")).union(spark.sql("SELECT explode(array('', '  ', '{bad', '[1,2]', '{\"question_id\": \"x\", \"candidates\": 5}')) AS value"))
    back = jsonl.tolerant(lines, schemas.SCORED)
    c = back.select(F.col("question_id").cast("long").alias("question_id"), "candidates")
    mass = F.aggregate("candidates", F.lit(0.0), lambda a, x: a + F.aggregate(arrays.token_probabilities(x["token_logprobs"]), F.lit(0.0), lambda s, y: s + y))
    return c.select("question_id", F.size("candidates").cast("long").alias("n"), F.array_join(F.transform("candidates", lambda x: F.coalesce(x["extracted_answer"], F.lit(""))), ",").alias("answers"), F.round(mass, 4).alias("mass"))


@query(
    """SELECT doc_id AS question_id, CAST(('0x' || substr(md5(
  '[{"role":"user","content":"' || lang || '"},{"role":"assistant","content":"' || source || '"},{"role":"user","content":"RATE"}]'), 1, 6)) AS INTEGER) % 101 AS score FROM documents""".replace("RATE", prompts.RATE)
)
def scorer_stub(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s = d.select(F.col("doc_id").alias("question_id"), F.col("lang").alias("problem"), F.lit(0).alias("pos"), F.lit(0).alias("slice_idx"), F.col("source").alias("slice"))
    return scorer.confidence_scores(s).select("question_id", "score")


@query(
    """WITH d AS (SELECT doc_id // 8 AS question_id, doc_id % 8 AS pos, doc_id % 5 = (doc_id // 8) % 5 AS ok, least(doc_id % 10 + 1, 8) AS kept, round(-(doc_id % 7) / 3.0, 4) AS lp FROM documents)
SELECT question_id, CAST(count(*) AS INTEGER) AS total, CAST(count(*) FILTER (WHERE ok) AS INTEGER) AS correct, round(count(*) FILTER (WHERE ok) / count(*), 6) AS accuracy,
  string_agg(CAST(kept AS VARCHAR), ',' ORDER BY pos) AS kept, round(sum(lp * kept), 3) AS mass FROM d GROUP BY question_id"""
)
def sampled_records(spark, sf_dir):
    k = F.col("doc_id")
    q = F.floor(k / 8)
    letter = lambda c: F.char(F.lit(65) + c % 5)
    g = table(spark, sf_dir, "documents").select(
        q.alias("question_id"),
        F.lit("").alias("problem"),
        letter(q).alias("gold_answer"),
        (k % 8).alias("pos"),
        F.concat(F.lit("so \\boxed{"), letter(k), F.lit("}")).alias("text"),
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i == k % 10, 2).otherwise(1)).alias("token_ids"),
        F.array_repeat(-(k % 7) / 3, 8).alias("token_logprobs"),
    )
    r = sampled.sampled_records(sampled.judged(g, eos=2))
    lists = F.transform("candidates", lambda c: F.size(c["token_logprobs"]).cast("string"))
    mass = F.aggregate("candidates", F.lit(0.0), lambda a, c: a + F.aggregate(c["token_logprobs"], F.lit(0.0), lambda s, x: s + x))
    return r.select("question_id", "stats.total", "stats.correct", r6("stats.accuracy").alias("accuracy"), F.array_join(lists, ",").alias("kept"), F.round(mass, 3).alias("mass"))


# Files: sources and sinks --------------------------------------------------------------------


def _folder(spark) -> str:
    """A folder of this run in the shared folder."""
    return f"{run_folder(spark)}/files-{uuid.uuid4().hex}"


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars, count(*) FILTER (WHERE source IS NULL) AS no_source FROM documents GROUP BY lang")
def jsonl_strict(spark, sf_dir):
    """Rows written as JSON lines, a part for each task, and read by the strict source."""
    path, kind = _folder(spark), table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    jsonl.write_records(kind, path)
    back = jsonl.read_strict(spark, path, kind.schema)
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"), F.count_if(F.col("source").isNull()).alias("no_source"))


@query("SELECT CAST(o_orderkey % 3 AS INTEGER) AS part, true AS found, count(*) AS lines, CAST(sum(o_custkey) AS BIGINT) AS merged FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY 1 UNION ALL SELECT 1, false, 0, 0")
def parts_merged(spark, sf_dir):
    """Three outputs, one of which was never written: what a merge finds, and its rows."""
    o, folder = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), _folder(spark)
    paths = [f"{folder}/part_{i}" for i in range(3)]
    for i in (0, 2):
        jsonl.write_records(o.where(F.col("o_orderkey") % 3 == i), paths[i], 1)
    rows = jsonl.merge_parts(spark, paths, o.schema)
    sums = rows.groupBy((F.col("o_orderkey") % 3).cast("int").alias("part")).agg(F.sum("o_custkey").alias("merged"))
    return jsonl.part_counts(spark, paths).join(sums, "part", "left").withColumn("merged", F.coalesce("merged", F.lit(0).cast("long")))


@query(SQL["selection_report"])
def report_sink(spark, sf_dir):
    """The report through its JSON file, written twice over, and back."""
    path = _folder(spark)
    rows = selection.report(records(spark, sf_dir)).withColumn("question_id", F.col("question_id").cast("string"))
    jsonl.write_records(rows.limit(1), path)
    jsonl.write_records(rows, path)
    back = jsonl.merge_parts(spark, [path], schemas.REPORT)
    return _shown(back.withColumn("question_id", F.col("question_id").cast("long")))


# Aliases, judging and scoring ----------------------------------------------------------------


@query(
    """SELECT p_partkey AS question_id, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END, ''), p_brand) AS problem,
  coalesce(CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END, 'None') AS gold_answer, count(*) OVER () AS n_ids FROM part"""
)
def question_aliases(spark, sf_dir):
    """Questions, gold answers and ids by column presence; ids made of the question where there is none."""
    p = table(spark, sf_dir, "part")
    q = p.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")).alias("question"),
        F.col("p_brand").alias("prompt"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("answerKey"),
    )
    made = q.select(F.concat_ws(" ", "question", "id").alias("problem"))
    n = made.select(schemas.id_of(made).alias("made")).agg(F.count_distinct("made").alias("n_ids"))
    return q.select(schemas.id_of(q).alias("question_id"), schemas.question_of(q).alias("problem"), schemas.gold_of(q).alias("gold_answer")).crossJoin(F.broadcast(n))  # one row


def _old_records(spark, sf_dir) -> DataFrame:
    """Records of a document each under the names of older files, with three candidates: one whose answer is
    read from its text, one that keeps its answer, one without any."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    letter = lambda n: F.char(F.lit(65) + k % n)
    none = F.lit(None).cast("string")

    def c(text, full, more, answer):
        return F.struct(text.alias("text"), full.alias("full_text"), more.alias("continuation_text"), answer.alias("extracted_answer"), F.lit(False).alias("is_correct"))

    first = F.concat(F.lit("so \\boxed{"), letter(5), F.lit("}"))
    made = F.array(c(none, first, none, none), c(F.lit("x"), none, none, letter(3)), c(none, none, F.concat(F.lit(".... "), k.cast("string")), none))
    problem = F.when(k % 2 == 0, "").otherwise(F.col("lang"))
    gold = F.when(k % 3 != 0, letter(3))
    stats = F.struct(F.lit(0).alias("total"), F.lit(0).alias("correct"), F.lit(0.0).alias("accuracy"))
    return d.select(k.alias("question_id"), problem.alias("problem"), F.col("source").alias("question"), gold.alias("gold_answer"), letter(5).alias("answer"), made.alias("candidates"), stats.alias("stats"))


_OLD = """o AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(source, '') ELSE coalesce(nullif(lang, ''), source, '') END AS problem,
  chr(CAST(65 + doc_id % (CASE WHEN doc_id % 3 <> 0 THEN 3 ELSE 5 END) AS INTEGER)) AS gold, chr(CAST(65 + doc_id % 5 AS INTEGER)) AS a, chr(CAST(65 + doc_id % 3 AS INTEGER)) AS b FROM documents)"""


@query(f"WITH {_OLD} SELECT doc_id AS question_id, a AS first, b AS kept, CAST(3 AS INTEGER) AS total, CAST((a = gold)::INT + (b = gold)::INT AS INTEGER) AS correct, round(((a = gold)::INT + (b = gold)::INT) / 3, 6) AS accuracy FROM o")
def fixed_records(spark, sf_dir):
    f = judging.fix_records(_old_records(spark, sf_dir))
    c = F.col("candidates")
    return f.select("question_id", c[0]["extracted_answer"].alias("first"), c[1]["extracted_answer"].alias("kept"), "stats.total", "stats.correct", r6("stats.accuracy").alias("accuracy"))


def _quoted(x: str) -> str:
    return x.replace("'", "''").replace("\n", "' || chr(10) || '")


@query(
    f"""WITH {_OLD} SELECT doc_id AS question_id, CAST(2 AS INTEGER) AS pos, md5('{_quoted(prompts.JUDGE)}' || chr(10) || chr(10) || 'Question:' || chr(10) || problem || chr(10) || chr(10) || 'Reference answer:' || chr(10) || gold
  || chr(10) || chr(10) || 'Response:' || chr(10) || '.... ' || doc_id || chr(10) || chr(10) || '{_quoted(prompts.JUDGE_RULES)}') AS prompt FROM o"""
)
def judge_routing(spark, sf_dir):
    """Only the candidate without an answer is asked about, by whatever names the record has."""
    asked = judging.to_judge(judging.fix_records(_old_records(spark, sf_dir)))
    return asked.select("question_id", "pos", F.md5(F.encode("prompt", "UTF-8")).alias("prompt"))


def _replies(texts: list) -> list:
    """A judge for queries: what it says follows from the number in the response."""
    out = []
    for t in texts:
        n = int(t.split(".... ")[1].split("\n")[0])
        out.append(['{"extracted_answer": "7", "is_correct": true}', '{"extracted_answer": "8", "is_correct": "true"}', '{"is_correct": 1}', "no JSON", '{"extracted_answer": "9", "is_correct": false}'][n % 5])
    return out


@query(
    f"""WITH {_OLD} SELECT doc_id AS question_id, CASE doc_id % 5 WHEN 0 THEN '7' WHEN 1 THEN '8' WHEN 4 THEN '9' END AS answer, doc_id % 5 = 0 AS is_correct,
  CAST((a = gold)::INT + (b = gold)::INT + (doc_id % 5 = 0)::INT AS INTEGER) AS correct FROM o"""
)
def judge_verdicts(spark, sf_dir):
    """A judge's replies: only a true boolean counts, and a reply of another shape is none."""
    fixed = judging.fix_records(_old_records(spark, sf_dir))
    said = scorer.scored_batches(judging.to_judge(fixed), "prompt", "reply", lambda: _replies, workers=4)
    r = judging.with_verdicts(fixed, said)
    last = F.col("candidates")[2]
    return r.select("question_id", last["extracted_answer"].alias("answer"), last["is_correct"].alias("is_correct"), "stats.correct")


@query(f"WITH {_OLD} SELECT count(*) AS records, CAST(3 * count(*) AS BIGINT) AS candidates, CAST(sum((a = gold)::INT + (b = gold)::INT) AS BIGINT) AS correct, count(*) AS judge_calls FROM o")
def run_counters(spark, sf_dir):
    return judging.run_counts(judging.fix_records(_old_records(spark, sf_dir)))


def _to_score(spark, sf_dir) -> DataFrame:
    """Records for the scorer: continuations for candidates, a shared prefix, and some that are left out."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    n = k.cast("string")
    c = lambda t, f: F.struct(t.alias("text"), f.alias("full_text"))
    none = F.lit(None).cast("string")
    made = F.array(c(F.concat(F.lit(" given "), n, F.lit("\n\none\n\ntwo ok<|im_end|>")), none), c(none, F.concat(F.lit("alone "), n)))
    made = F.when(k % 7 == 0, F.array(c(none, none))).when(k % 7 == 1, F.array().cast("array<struct<text:string,full_text:string>>")).otherwise(made)
    stats = F.when(k % 5 != 0, F.struct(F.size(made).alias("total"), F.lit(0).alias("correct"), F.lit(0.0).alias("accuracy")))
    return d.select(k.alias("question_id"), F.lit("p").alias("problem"), F.concat(F.lit("given "), n).alias("full_poisoned_prefix"), made.alias("continuations"), stats.alias("stats"))


@query(
    """WITH d AS (SELECT doc_id FROM documents WHERE doc_id % 7 > 1 AND doc_id % 5 <> 0)
SELECT doc_id AS question_id, 0 AS pos, 0 AS slice_idx, 'given ' || doc_id || chr(10) || 'one' || chr(10) || chr(10) || 'two ok' AS slice FROM d
UNION ALL SELECT doc_id, 0, 1, 'given ' || doc_id || chr(10) || 'one' FROM d UNION ALL SELECT doc_id, 1, 0, 'given ' || doc_id || chr(10) || 'alone ' || doc_id FROM d"""
)
def continuations_sliced(spark, sf_dir):
    """Slices of candidates by their other name, with the shared prefix set apart in front of each."""
    return judging.slices_of(judging.scorable(_to_score(spark, sf_dir)), schemas.SamplingConfig(poisoned=True)).select("question_id", "pos", "slice_idx", "slice")


@query(
    """SELECT doc_id AS question_id, CASE WHEN doc_id % 7 = 1 THEN -1.0 ELSE round(((doc_id % 50 + doc_id % 50 + 20) / 2 + doc_id % 30) / 2, 6) END AS avg_confidence,
  CAST(CASE WHEN doc_id % 7 = 1 THEN -1 ELSE least(doc_id % 50, doc_id % 30) END AS INTEGER) AS least_score FROM documents WHERE doc_id % 7 = 1 OR (doc_id % 7 > 1 AND doc_id % 5 <> 0)"""
)
def record_confidence(spark, sf_dir):
    """Scores back into records: means of candidates and of records; records that the stage drops or hands on."""
    records = _to_score(spark, sf_dir)
    s, q = judging.slices_of(judging.scorable(records)).select("question_id", "pos", "slice_idx"), F.col("question_id")
    score = F.when(F.col("pos") == 1, q % 30).otherwise(q % 50 + 20 * F.col("slice_idx")).cast("int")
    r = judging.with_scores(records, s.withColumn("score", score))
    least = F.array_min(F.transform("candidates", lambda c: c["min_verbal_score"]))
    return r.select("question_id", F.coalesce(r6("stats.avg_confidence"), F.lit(-1.0)).alias("avg_confidence"), F.coalesce(least, F.lit(-1)).alias("least_score"))


def _generator():
    """A generator for queries: questions of one rest modulo 3 succeed, of another fail every second time, of
    the last always."""
    calls: dict[str, int] = {}

    def make(prompt: str, n: int) -> list[dict]:
        k = calls[prompt] = calls.get(prompt, 0) + 1
        kind = int(prompt.split()[-1]) % 3
        if kind == 2 or kind == 1 and k % 2:
            raise RuntimeError
        return [{"text": f"{prompt} {k}"} for _ in range(n)]

    return make


@query(
    """SELECT doc_id AS question_id, CAST(4 AS BIGINT) AS with_retries, CAST(CASE doc_id % 3 WHEN 0 THEN 4 ELSE 2 END AS BIGINT) AS without FROM documents WHERE doc_id % 3 < 2"""
)
def generated_with_retries(spark, sf_dir):
    """Candidates that a generator makes of each question, with retries and where a failure skips a batch."""
    q = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.concat(F.lit("ask "), F.col("doc_id").cast("string")).alias("prompt"))

    def n(name: str, retries):
        config = schemas.SamplingConfig(n_samples=4, micro_batch=1, retries=retries, workers=4)
        return scorer.generated(q, "prompt", _generator, "text string", config).groupBy("question_id").agg(F.count(F.lit(1)).alias(name))

    return n("with_retries", 5).join(n("without", None), "question_id", "full")


@query(
    """SELECT n_nationkey AS question_id, 'Which? ' || n_name || chr(10) || chr(10) || 'Options:' || chr(10) || 'A. ' || n_name || chr(10) || 'B. None' || chr(10) || 'C. it''s 7' || chr(10) || 'D. 2.5' || chr(10) || chr(10) || chr(10) || '"""
    + _quoted(prompts.SOLVE)
    + """' AS prompt FROM nation"""
)
def asked_with_options(spark, sf_dir):
    """Visual questions: a list literal of options, with a bare None and a number, under a heading."""
    n = table(spark, sf_dir, "nation")
    literal = F.concat(F.lit("['"), F.col("n_name"), F.lit("', None, \"it's 7\", 2.5]"))
    q = n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("Which? "), "n_name").alias("question"), F.lit("A").alias("answer"), literal.alias("options"))
    return sampled.asked(q, schemas.SamplingConfig(sample_size=-1), visual=True).select("question_id", "prompt")


@query("SELECT o_orderkey FROM orders ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100")
def seeded_sample(spark, sf_dir):
    return sampling.hash_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, schemas.SamplingConfig().seed)


@query(
    f"""WITH {CAND}, {jitter_cte(20)}, x AS (SELECT question_id, pos, CASE WHEN question_id % 2 = 0 AND pos = 3 THEN CAST('NaN' AS DOUBLE) ELSE jitter END AS j FROM feat)
SELECT question_id % 2 AS half, CASE WHEN question_id % 2 = 0 THEN 'NaN' ELSE CAST(round(quantile_cont(j, 0.9), 4) AS VARCHAR) END AS t_hi FROM x GROUP BY 1"""
)
def thresholds_of_nan(spark, sf_dir):
    """One NaN among the values makes both forms of a threshold NaN."""
    rows = long_features(spark, sf_dir).withColumn("jitter", F.when((F.col("question_id") % 2 == 0) & (F.col("pos") == 3), float("nan")).otherwise(F.col("jitter")))
    out = None
    for half in (0, 1):
        part = rows.where(F.col("question_id") % 2 == half)
        one, two = pruning.thresholds(part, "jitter", 10, 90).select("t_hi"), pruning.exact_thresholds(part, "jitter", 10, 90).select(F.col("t_hi").alias("t"))
        same = F.isnan("t_hi") & F.isnan("t") | (F.abs(F.col("t_hi") - F.col("t")) < 1e-12)
        shown = F.when(~same, "different").when(F.isnan("t_hi"), "NaN").otherwise(F.round("t_hi", 4).cast("string"))
        got = one.crossJoin(two).select(F.lit(half).cast("long").alias("half"), shown.alias("t_hi"))  # one row each
        out = got if out is None else out.unionByName(got)
    return out


@query(
    f"""WITH {CAND} SELECT question_id, count(*) AS n FROM cand WHERE question_id % 4 <> 1 GROUP BY question_id"""
)
def overflow_dropped(spark, sf_dir):
    """A record with a log-probability whose exp is beyond doubles is left out; an infinite one is not."""
    big = F.when((F.col("question_id") % 4 == 1) & (F.col("pos") == 2), F.array(F.lit(800.0))).when((F.col("question_id") % 4 == 2) & (F.col("pos") == 2), F.array(F.lit(float("inf"))))
    c = F.struct("pos", F.col("answer").alias("extracted_answer"), F.col("flag").alias("is_correct"), F.coalesce(big, "logprobs").alias("token_logprobs"), F.array("score").alias("interval_scores"))
    r = candidates(spark, sf_dir).groupBy("question_id", F.col("gold").alias("gold_answer")).agg(F.sort_array(F.collect_list(c)).alias("candidates"))
    return selection.features(r).select("question_id", F.size("pool").cast("long").alias("n"))


# Records that share an id, percentiles with infinities ------------------------------------------


def _asked(prompts_: DataFrame) -> DataFrame:
    return scorer.scored_batches(prompts_, "prompt", "reply", lambda: _replies, workers=4)


@query(
    """SELECT doc_id // 2 AS question_id, doc_id, CASE doc_id % 5 WHEN 0 THEN '7' WHEN 1 THEN '8' WHEN 4 THEN '9' END AS answer, doc_id % 5 = 0 AS is_correct,
  CAST((doc_id % 5 = 0)::INT AS INTEGER) AS correct FROM documents"""
)
def judged_repeats(spark, sf_dir):
    """Two records of each question_id: each keeps the verdict on its own candidate."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    c = F.struct(F.concat(F.lit(".... "), k.cast("string")).alias("text"), F.lit(None).cast("string").alias("extracted_answer"), F.lit(False).alias("is_correct"))
    r = judging.judged_records(d.select(F.floor(k / 2).alias("question_id"), F.lit("p").alias("problem"), F.lit("A").alias("gold_answer"), F.array(c).alias("candidates")), _asked)
    one = F.col("candidates")[0]
    return r.select("question_id", F.regexp_extract(one["text"], "[0-9]+", 0).cast("long").alias("doc_id"), one["extracted_answer"].alias("answer"), one["is_correct"].alias("is_correct"), "stats.correct")


@query(
    """WITH s AS (SELECT doc_id, CAST(('0x' || substr(md5('[{"role":"user","content":"p"},{"role":"assistant","content":"alone ' || doc_id || '"},{"role":"user","content":"RATE"}]'), 1, 6)) AS INTEGER) % 101 AS score FROM documents)
SELECT doc_id // 2 AS question_id, doc_id, CAST(1 AS INTEGER) AS n_scores, CAST(score AS DOUBLE) AS avg_confidence FROM s""".replace("RATE", prompts.RATE)
)
def scored_repeats(spark, sf_dir):
    """Two records of each question_id through the scoring stage: each keeps its own score."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    stats = F.struct(F.lit(1).alias("total"), F.lit(0).alias("correct"), F.lit(0.0).alias("accuracy"))
    c = F.array(F.struct(F.concat(F.lit("alone "), k.cast("string")).alias("text")))
    r = judging.scored_records(d.select(F.floor(k / 2).alias("question_id"), F.lit("p").alias("problem"), c.alias("candidates"), stats.alias("stats")), scorer.confidence_scores)
    one = F.col("candidates")[0]
    return r.select("question_id", F.regexp_extract(one["text"], "[0-9]+", 0).cast("long").alias("doc_id"), F.size(one["interval_scores"]).alias("n_scores"), "stats.avg_confidence")


_POINTS = (0.1, 0.5, 0.9, 0.97, 1.0)


@query(
    f"""WITH {CAND}, {jitter_cte(20)}, x AS (SELECT list_sort(list(CASE WHEN pos = 3 THEN CAST('Infinity' AS DOUBLE) WHEN pos IN (4, 5) THEN 0.0 ELSE jitter END)) AS l FROM feat),
p AS (SELECT l, unnest({list(_POINTS)}::DOUBLE[]) AS point FROM x), r AS (SELECT *, point * (len(l) - 1) AS place FROM p),
v AS (SELECT point, l[CAST(floor(place) AS INT) + 1] AS a, l[least(CAST(floor(place) AS INT) + 2, len(l))] AS b, place - floor(place) AS f FROM r)
SELECT point, CASE WHEN a = b OR f = 0 THEN CASE WHEN isinf(a) THEN 'Infinity' ELSE CAST(round(a, 4) AS VARCHAR) END WHEN isinf(b) THEN 'Infinity' ELSE CAST(round(a + (b - a) * f, 4) AS VARCHAR) END AS value FROM v"""
)
def percentiles_of_infinities(spark, sf_dir):
    """Ties and infinities among the values: several points in two passes, and the aggregate's percentiles."""
    pos = F.col("pos")
    rows = long_features(spark, sf_dir).select(F.when(pos == 3, float("inf")).when(pos.isin(4, 5), 0.0).otherwise(F.col("jitter")).alias("j"))
    rows = materialised(rows, "jitters")
    got = pruning.percentiles(rows, "j", list(_POINTS), small=20)
    want = rows.agg(F.percentile("j", F.array(*map(F.lit, _POINTS))).alias("w"))
    both = want.select(F.posexplode("w").alias("i", "w")).withColumn("g", F.element_at(F.array(*map(F.lit, got)), F.col("i") + 1)).withColumn("point", F.element_at(F.array(*map(F.lit, _POINTS)), F.col("i") + 1))
    same = (F.col("w") == F.col("g")) | (F.abs(F.col("w") - F.col("g")) < 1e-12)
    return both.select("point", F.when(~same, "different").otherwise(F.when(F.col("g") == float("inf"), "Infinity").otherwise(F.round("g", 4).cast("string"))).alias("value"))


# Whole segmentation ------------------------------------------------------------------------------


@query(
    r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
s AS (SELECT doc_id, t, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS s FROM t),
c AS (SELECT doc_id, s, len(s) AS n, list_transform(range(len(s) + 1), lambda k: coalesce(list_sum(list_transform(s[1:k], lambda x: length(x) + 1)), 0)) AS cum FROM s WHERE len(s) > 0),
m AS (SELECT *, unnest([1, 3, 10]) AS intervals FROM c),
fold AS (SELECT doc_id, intervals, s, n, cum, 0 AS made, 0 AS pos FROM m UNION ALL
  SELECT doc_id, intervals, s, n, cum, made + 1, CASE WHEN made + 1 < intervals THEN coalesce(list_filter(range(pos + 1, n + 1), lambda k: cum[k + 1] - cum[pos + 1] >= (cum[n + 1] - 1) / intervals)[1], n) ELSE n END FROM fold WHERE pos < n)
SELECT doc_id, intervals, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY made) AS ends, md5(string_agg(array_to_string(s[1:pos], chr(10)), '|' ORDER BY made)) AS slices FROM fold WHERE pos > 0 GROUP BY doc_id, intervals"""
)
def cumulative_slices(spark, sf_dir):
    """Every cumulative slice, for several numbers of intervals; texts without any step have none here."""
    d = table(spark, sf_dir, "documents")
    out = None
    for n in (1, 3, 10):
        steps = F.filter(F.split(text.strip(F.col("text")), "\n", -1), lambda x: x.rlike(r"(?U)\S"))
        ends = F.array_join(F.transform(arrays.interval_ends(steps, n, "\n"), lambda e: e.cast("string")), ",")
        slices = F.md5(F.encode(F.array_join(arrays.cumulative_slices(F.col("text"), n, "\n"), "|"), "UTF-8"))
        got = d.where(F.size(steps) > 0).select("doc_id", F.lit(n).alias("intervals"), ends.alias("ends"), slices.alias("slices"))
        out = got if out is None else out.unionByName(got)
    return out


@query(f"SELECT doc_id, intervals, ends FROM ({SQL['cumulative_slices']})")
def segments_long(spark, sf_dir):
    """The same ends from a row for each step, by prefix sums and pointer doubling."""
    d = table(spark, sf_dir, "documents")
    steps = F.filter(F.split(text.strip(F.col("text")), "\n", -1), lambda x: x.rlike(r"(?U)\S"))
    rows = d.select(F.col("doc_id").alias("key"), F.posexplode(steps).alias("step", "x")).select("key", "step", F.length("x").alias("length"))
    out = None
    for n in (1, 3, 10):
        ends = segments.segments(rows, n, 1).groupBy("key", "segment").agg((F.max("step") + 1).alias("end"))
        got = ends.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("end")), lambda e: e.cast("string")), ",").alias("ends")).select(F.col("key").alias("doc_id"), F.lit(n).alias("intervals"), "ends")
        out = got if out is None else out.unionByName(got)
    return out


# Sinks that go on, counts in the same pass, lines that are dropped ---------------------------------


@query(
    """SELECT doc_id AS question_id, CAST(('0x' || substr(md5('[{"role":"user","content":"p"},{"role":"assistant","content":"alone ' || doc_id || '"},{"role":"user","content":"RATE"}]'), 1, 6)) AS INTEGER) % 101 AS score,
  CAST(1 AS BIGINT) AS times, true AS as_uninterrupted FROM documents""".replace("RATE", prompts.RATE)
)
def resumed_run(spark, sf_dir):
    """A run that fails after some rounds and goes on, and one that doesn't fail."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.lit("p").alias("problem"), F.lit(0).alias("pos"), F.lit(0).alias("slice_idx"), F.concat(F.lit("alone "), F.col("doc_id").cast("string")).alias("slice"))
    calls: list[int] = []

    def failing(rows: DataFrame) -> DataFrame:
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("stopped")
        return scorer.confidence_scores(rows)

    stopped, whole = _folder(spark), _folder(spark)
    try:
        sinks.resumed(d, stopped, failing, "question_id", rounds=4)
    except RuntimeError:
        sinks.resumed(d, stopped, scorer.confidence_scores, "question_id", rounds=4)
    sinks.resumed(d, whole, scorer.confidence_scores, "question_id", rounds=1)
    kind = T.StructType().add("question_id", "long").add("score", "integer")
    one, two = (sinks.results(spark, p, kind) for p in (stopped, whole))
    times = one.groupBy("question_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("times"))
    return times.join(two.select("question_id", F.col("score").alias("other")), "question_id", "full").select("question_id", "score", "times", F.col("score").eqNullSafe(F.col("other")).alias("as_uninterrupted"))


def _lines(spark, sf_dir) -> DataFrame:
    """Lines in order of doc_id: most are records, some are blank, broken or of another shape."""
    k = F.col("question_id") % 11
    line = F.when(k == 3, "  ").when(k == 5, "{bad").when(k == 7, '{"candidates": 5}').otherwise(F.to_json(F.struct("*")))
    return _old_records(spark, sf_dir).orderBy("question_id").select(line.alias("value"))


@query(
    f"""WITH {_OLD}, k AS (SELECT * FROM o WHERE doc_id % 11 NOT IN (3, 5, 7)) SELECT (SELECT count(*) FROM o) AS lines, (SELECT count(*) FROM o WHERE doc_id % 11 = 3) AS blank, (SELECT count(*) FROM o WHERE doc_id % 11 IN (5, 7)) AS dropped,
  count(*) AS records, CAST(3 * count(*) AS BIGINT) AS candidates, CAST(sum((a = gold)::INT + (b = gold)::INT) AS BIGINT) AS correct, count(*) AS judge_calls FROM k"""
)
def run_counters_observed(spark, sf_dir):
    """Lines, dropped lines and the counts of the fixing stage, all from the pass that writes its records."""
    lines, counts = Observation(), Observation()
    fixed = judging.fix_records(jsonl.tolerant(_lines(spark, sf_dir), schemas.FIXED, seen=lines))
    jsonl.write_records(judging.observed(fixed, counts), _folder(spark))
    return spark.createDataFrame([lines.get | counts.get], "lines long, blank long, dropped long, records long, candidates long, correct long, judge_calls long")


@query(
    """WITH r AS (SELECT doc_id, doc_id % 11 AS k, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents)
SELECT CASE k WHEN 3 THEN 'blank' WHEN 5 THEN 'not JSON' ELSE 'other types' END AS reason, count(*) AS n, CAST(sum(row) AS BIGINT) AS rows_sum FROM r WHERE k IN (3, 5, 7) GROUP BY k
UNION ALL SELECT 'kept', count(*), 0 FROM r WHERE k NOT IN (3, 5, 7)"""
)
def quarantined_lines(spark, sf_dir):
    """Kept records and rejected lines of a file, with reasons and row numbers; together they are all lines."""
    path = _folder(spark)
    _lines(spark, sf_dir).coalesce(1).write.text(path)  # one file, whose row numbers follow from the ids
    kept, rejected = jsonl.quarantined(spark, path, schemas.FIXED)
    bad = rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("row").alias("rows_sum"))
    return bad.unionByName(kept.agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("rows_sum")))


# Replies that are kept, images, literals, SQL ------------------------------------------------------


def _graded(texts: list) -> list:
    return [f"grade {len(t)}" for t in texts]


@query(
    """WITH p AS (SELECT doc_id, lang || ' ' || source AS ask FROM documents) SELECT doc_id, 'grade ' || length(ask) AS reply,
  (SELECT count(DISTINCT ask) FROM p WHERE doc_id % 3 = 0) AS asked_first, (SELECT count(DISTINCT ask) FROM p WHERE ask NOT IN (SELECT ask FROM p WHERE doc_id % 3 = 0)) AS asked_then FROM p"""
)
def replies_kept(spark, sf_dir):
    """Two runs with one reply table: of equal questions one is asked, and the second run asks what the first didn't."""
    d, folder = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "lang", "source").alias("ask")), _folder(spark)
    ask = lambda rows: replies.answered(rows, "ask", "reply", lambda: _graded, folder, workers=4)
    ask(d.where("doc_id % 3 = 0"))
    first = replies.kept_replies(spark, folder).count()
    out = ask(d)
    then = replies.kept_replies(spark, folder).count() - first
    return out.select("doc_id", "reply", F.lit(first).cast("long").alias("asked_first"), F.lit(then).cast("long").alias("asked_then"))


def _as_png(numbers, width: int) -> bytes:
    """A grey image of numbers from 0 to 255, rows one after the other, each with another filter."""
    import struct
    import zlib

    rows = [bytes(numbers[i : i + width]) for i in range(0, len(numbers), width)]
    lines, above = b"", bytes(width)
    for y, row in enumerate(rows):
        left = bytes(1) + row[:-1]
        base = [bytes(width), left, above][y % 3]
        lines += bytes([y % 3]) + bytes((a - b) % 256 for a, b in zip(row, base))
        above = row
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@query(
    """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT) % 256) AS p FROM embeddings)
SELECT vec_id, CAST(CASE WHEN vec_id % 5 > 1 THEN 16 ELSE -1 END AS INTEGER) AS width, CAST(CASE WHEN vec_id % 5 > 1 THEN 4 ELSE -1 END AS INTEGER) AS height, CASE WHEN vec_id % 5 > 1 THEN round(list_avg(p), 6) ELSE -1.0 END AS mean, vec_id % 5 = 1 AS faulty FROM p"""
)
def images_decoded(spark, sf_dir):
    """Image files made of vectors, decoded in the workers; some have no bytes and some are damaged."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000) % 256).alias("p"))

    def draw(frames):
        for f in frames:
            files = [None if i % 5 == 0 else _as_png(list(p), 16)[: 60 if i % 5 == 1 else None] for i, p in zip(f["vec_id"], f["p"])]
            yield f[["vec_id"]].assign(image_1=files)

    out = images.described(e.mapInPandas(draw, "vec_id long, image_1 binary").select("vec_id", F.when(F.col("image_1").isNotNull(), F.struct(F.col("image_1").alias("bytes"))).alias("image_1")))
    least = lambda c: F.coalesce(c, F.lit(-1))
    return out.select("vec_id", least("image.width").alias("width"), least("image.height").alias("height"), least(r6("image.mean")).alias("mean"), F.col("image.fault").isNotNull().alias("faulty"))


@query(
    r"""SELECT n_nationkey, 'A. ' || n_name || chr(10) || 'B. -1' || chr(10) || 'C. 1000' || chr(10) || 'D. ab' || chr(10) || 'E. a\b' || chr(10) || 'F. A' || chr(10) || 'G. [''x'', None, (1,)]' || chr(10) || 'H. {''k'': 2.5}' || chr(10) AS options FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT n_nationkey, CASE n_nationkey % 4 WHEN 1 THEN 'A. it''s, [' || n_name || ']' || chr(10) || 'B. "' || chr(10) ELSE '' END FROM nation WHERE n_nationkey % 2 = 1"""
)
def option_literals(spark, sf_dir):
    """List literals with all that Python's have: signs, underscores, adjacent texts, raw ones, escapes, nesting."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    odd = F.concat(F.lit("['"), "n_name", F.lit(r"""', -1, 1_000, 'a' "b", r'a\b', 'A', ['x', None, (1,)], {'k': 2.5}]"""))
    plain = F.concat(F.lit('["it\'s, ['), "n_name", F.lit(''']", '"']'''))
    k = F.col("n_nationkey")
    return n.select("n_nationkey", prompts.option_list(F.when(k % 2 == 0, odd).when(k % 4 == 1, plain).otherwise(F.concat(F.lit("['"), "n_name"))).alias("options"))


@query(SQL["jitter_b10"])
def sql_jitter(spark, sf_dir):
    """The jitter as a function of SQL."""
    sql_functions.register(spark)
    return spark.sql("SELECT question_id, pos, round(token_jitter(logprobs, 10), 6) AS jitter FROM {c}", c=candidates(spark, sf_dir))


@query(SQL["vote_invalid_bucket"])
def sql_vote(spark, sf_dir):
    """The vote as a function of SQL."""
    sql_functions.register(spark)
    pools = selection.features(records(spark, sf_dir))
    return spark.sql("SELECT question_id, v.answer, round(v.confidence, 6) AS confidence, v.is_correct FROM (SELECT question_id, majority_vote(transform(pool, x -> named_struct('ans', x.ans, 'ok', x.ok)), gold) AS v FROM {p})", p=pools)


@query(SQL["extract_gpq_build"])
def sql_extraction(spark, sf_dir):
    """Extraction as a function of SQL."""
    sql_functions.register(spark)
    return spark.sql("SELECT doc_id, option_answer(t) AS answer FROM {a}", a=_answers(spark, sf_dir))


def _echo():
    return lambda prompt, n: [f"{prompt} {i}" for i in range(n)]


@query("SELECT doc_id AS question_id, CAST(i AS INTEGER) AS pos, 'ask ' || doc_id || ' ' || i AS text FROM documents, range(3) AS r(i)")
def sql_generated(spark, sf_dir):
    """Candidates that a generator makes, as a table function of SQL."""
    sql_functions.register_generator(spark, "candidates_of", _echo)
    q = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.concat(F.lit("ask "), F.col("doc_id").cast("string")).alias("prompt"))
    return spark.sql("SELECT question_id, pos, text FROM {q}, LATERAL candidates_of(prompt, 3)", q=q)
