"""Chat formatting by schema fingerprinting, on built-in functions only.

A layout is known by its fingerprint: the hash of its sorted nested field paths, of those that
some mapping reads.  Each fingerprint selects a declarative mapping, a list of turns given as
(role, path), or the path of a turn array.  The table of fingerprints holds every set of such
paths; where a set has the paths of several mappings, the one with the most paths is entered.
Tables are looked up once, when the plan is made; JSON records of mixed layouts row by row, by
hashing the paths present in each record.

The template is ``<|turn|>role\\ntext<|end|>`` for each turn.  Inside roles and texts ``&``,
``<`` and ``[`` become ``&amp;``, ``&lt;`` and ``&lbr;`` (and a line break in a role
``&nl;``), so no control string of this or other templates can appear there, and every text
can be read back exactly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from plumbline.llm.common import table

TURN, END = "<|turn|>", "<|end|>"
#: Role names of common layouts and their canonical names.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


@dataclass(frozen=True)
class Mapping:
    """``array`` with ``role`` and ``text`` below it, or ``turns`` of (role, path), or flat rows."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    array: str = ""
    role: str = ""
    text: str = ""


MAPPINGS = (
    Mapping("rows", ("turn", "role", "text")),
    Mapping("messages", ("messages", "messages.role", "messages.content"), array="messages", role="role", text="content"),
    Mapping("from_value", ("conversations", "conversations.from", "conversations.value"), array="conversations", role="from", text="value"),
    Mapping("instruction_input", ("instruction", "input", "output"), (("user", "instruction+input"), ("assistant", "output"))),
    Mapping("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Mapping("system_prompt", ("system", "prompt", "response"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", ("prompt", "completion"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping("question_answer", ("question", "answer"), (("user", "question"), ("assistant", "answer"))),
)


#: Groups of paths that mean something together alone; all other paths stand for themselves.
GROUPS = [m.paths for m in MAPPINGS if m.array or not m.turns]
UNITS = [*GROUPS, *sorted({(p,) for m in MAPPINGS for _, t in m.turns for p in t.split("+")})]


def fingerprint(paths) -> str:
    """Hash of the field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def known(paths) -> set[str]:
    """Those of the paths that mappings read; of a group all or none."""
    have = set(paths)
    return {p for unit in UNITS if have.issuperset(unit) for p in unit}


def _table() -> dict[str, Mapping]:
    """Fingerprint -> mapping, for every set of units that holds the paths of one."""
    out = {}
    for bits in range(1 << len(UNITS)):
        have = {p for i, unit in enumerate(UNITS) if bits >> i & 1 for p in unit}
        fits = [m for m in MAPPINGS if have.issuperset(m.paths)]
        if fits:
            out[fingerprint(have)] = max(fits, key=lambda m: len(m.paths))
    return out


BY_FINGERPRINT = _table()


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths; arrays are transparent."""
    while isinstance(schema, T.ArrayType):
        schema = schema.elementType
    if not isinstance(schema, T.StructType):
        return []
    out = []
    for f in schema.fields:
        out.append(path := f"{prefix}{f.name}")
        out += field_paths(f.dataType, f"{path}.")
    return out


def mapping_for(schema: T.StructType) -> Mapping:
    """The mapping under the fingerprint of the schema's known paths; other columns don't count.
    Unknown layouts raise ValueError."""
    mark = fingerprint(known(field_paths(schema)))
    if mark not in BY_FINGERPRINT:
        raise ValueError(f"no mapping for fingerprint {mark} of {sorted(field_paths(schema))}")
    return BY_FINGERPRINT[mark]


def _role(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    names = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(out)), out)


def _turns(m: Mapping, at) -> Column:
    """array<struct<turn, role, text>> of one record; ``at`` gives the column of a path."""
    if m.array:
        return F.transform(
            F.coalesce(at(m.array), F.array()),
            lambda x, i: F.struct(i.cast("long").alias("turn"), _role(x[m.role]).alias("role"), F.coalesce(x[m.text].cast("string"), F.lit("")).alias("text")),
        )

    def text(path: str) -> Column:
        first, *more = (F.coalesce(at(p).cast("string"), F.lit("")) for p in path.split("+"))
        for x in more:
            first = F.concat(first, F.when(x == "", "").otherwise(F.concat(F.lit("\n\n"), x)))
        return first

    return F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), text(path).alias("text")) for i, (role, path) in enumerate(m.turns)])


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text of a table of any known layout; null texts are empty."""
    m = mapping_for(df.schema)
    if m.name == "rows":
        return df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return df.select(F.col(id_col).alias("conv_id"), F.explode(_turns(m, lambda p: F.col(p))).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")


#: One parse reads the fields of every layout that a JSON record may have.
JSON_SCHEMA = T.StructType(
    [
        T.StructField("messages", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
        T.StructField("conversations", T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())]))),
        *[T.StructField(n, T.StringType()) for n in ("instruction", "input", "output", "system", "prompt", "response", "completion", "question", "answer")],
    ]
)


def canonical_json(df: DataFrame, json_col: str, id_col: str = "conv_id") -> DataFrame:
    """conv_id, layout, turn, role, text of JSON records of mixed layouts.

    The known paths present in each record are hashed and the hash picks the mapping.  A record of
    no known layout, or one that isn't JSON, gives one row with null layout, turn, role and text.
    A null field is not present; an empty text is.  An empty table gives no rows.
    """
    r = df.select(F.col(id_col).alias("conv_id"), F.from_json(json_col, JSON_SCHEMA).alias("r"))

    def present(unit: tuple[str, ...]) -> Column:
        tests = []
        for path in unit:
            top, _, below = path.partition(".")
            there = F.col("r")[top].isNotNull()
            tests.append(there & F.exists(F.col("r")[top], lambda x: x[below].isNotNull()) if below else there)
        all_ = tests[0]
        for t in tests[1:]:
            all_ = all_ & t
        return F.when(all_, F.lit("\n".join(unit)))

    units = [u for u in UNITS if u[0].partition(".")[0] in JSON_SCHEMA.names]
    paths = F.array_sort(F.split(F.concat_ws("\n", F.array_compact(F.array(*map(present, units)))), "\n"))
    r = r.withColumn("mark", F.substring(F.sha2(F.encode(F.array_join(paths, "\n"), "UTF-8"), 256), 1, 16))
    table_ = df.sparkSession.createDataFrame([(k, m.name) for k, m in BY_FINGERPRINT.items()], "mark string, layout string")  # a set number of rows
    r = r.join(F.broadcast(table_), "mark", "left")
    turns = F.lit(None).cast("array<struct<turn:bigint,role:string,text:string>>")
    for m in MAPPINGS:
        if m.name != "rows":
            turns = F.when(F.col("layout") == m.name, _turns(m, lambda p: F.col("r")[p])).otherwise(turns)
    return r.select("conv_id", "layout", F.explode_outer(turns).alias("t")).select("conv_id", "layout", "t.turn", "t.role", "t.text")


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ("[", "&lbr;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescaped(c: Column) -> Column:
    for a, b in (("\n", "&nl;"), ("[", "&lbr;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted string, loss_spans array<struct<start long, length long>>.

    ``turns`` has conv_id, turn, role, text.  Turns go in order of turn, then role, then
    text; rows that repeat each make a turn.  Null roles and texts are empty, a null turn comes
    first, a null conv_id is one more conversation, and an empty table gives no rows.  Spans count code points of ``formatted`` from 0
    and cover the text of each assistant turn and nothing else.
    """
    t = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("&nl;")).alias("head"),
        escaped(F.coalesce("text", F.lit(""))).alias("body"),
    )
    w = W.partitionBy("conv_id").orderBy("turn", "head", "body").rowsBetween(W.unboundedPreceding, W.currentRow)
    size = F.lit(len(TURN) + 1 + len(END)) + F.length("head") + F.length("body")
    t = t.withColumn("after", F.sum(size).over(w))
    t = t.withColumn("piece", F.struct("after", "role", "head", "body"))
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("piece")).alias("p"))
    return g.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: F.concat(F.lit(TURN), x["head"], F.lit("\n"), x["body"], F.lit(END))), "").alias("formatted"),
        F.transform(
            F.filter("p", lambda x: x["role"] == "assistant"),
            lambda x: F.struct((x["after"] - len(END) - F.length(x["body"])).alias("start"), F.length(x["body"]).cast("long").alias("length")),
        ).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, loss_text: what the formatted output says."""
    parts = F.filter(F.split("formatted", r"<\|turn\|>"), lambda x, i: i > 0)
    body = lambda x: F.substring_index(x, END, 1)
    turns = F.transform(
        parts,
        lambda x: F.struct(
            unescaped(F.substring_index(x, "\n", 1)).alias("role"),
            unescaped(F.substr(body(x), F.instr(x, "\n") + 1)).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))), "")
    return formatted.select("conv_id", turns.alias("turns"), unescaped(loss).alias("loss_text"), F.length("formatted").alias("formatted_chars"))


#: Fixed values of the contract: a conversation that says control strings.
EXTRA = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op7_chat_format(spark, sf_dir):
    extra = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in EXTRA) + " AS v(conv_id, turn, role, text)")
    turns = canonical_turns(table(spark, sf_dir, "conversations")).unionByName(extra)
    out = read_back(format_conversations(turns))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


ORACLE = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lbr;') AS body,
  replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lbr;'), chr(10), '&nl;') AS head FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, head, body)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, head, body) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(16 + length(head) + length(body)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
