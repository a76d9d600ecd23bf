"""Exact dedup by deterministic block naming.

Each text is normalised (white space deleted), encoded as UTF-8 and cut into blocks of a
fixed number of bytes.  Blocks that occur more than once are sorted into names: all equal
blocks, and no others, carry the same integer pair (smallest document, block number).
Adjacent names are then paired and the pairs named in the same way, level by level, until
one name stands for the whole document.  No hash decides equality, so an identity cannot
collide.  A document that holds a block found nowhere else is its own identity at once and
takes no part in the recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import only, text_key, written

#: Bytes of a block.  Most documents are one or two blocks.
BLOCK_BYTES = 4096


def normalised(name: str = "text") -> Column:
    """The text without ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(F.col(name), F.lit("")), " \t\n\x0b\f\r", "")


def _name_of(d: Column, k: Column, i: Column) -> Column:
    return F.struct(d.alias("d"), k.alias("k"), i.cast("int").alias("i"))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, key, name: ``name`` is equal exactly where the normalised texts are equal.

    ``key`` tells rows that repeat a doc_id with another text apart.  Documents with a
    block of their own have a name made of their own doc_id and key.
    """
    rows = docs.select(
        "doc_id",
        text_key().alias("key"),
        F.encode(normalised(), "UTF-8").alias("b"),
    )
    n = F.greatest(F.ceil(F.octet_length("b") / F.lit(block_bytes)), F.lit(1)).cast("int")
    blocks = rows.select(
        "doc_id",
        "key",
        n.alias("n"),
        F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("b"), i * block_bytes + 1, F.lit(block_bytes)))).alias("i", "block"),
    )
    # Sorting aggregation: the partial step folds copies before anything is shuffled.  Names are written,
    # so that a block which a large part of all rows hold is a skewed join that AQE can split.
    names = written(
        blocks.groupBy("block")
        .agg(F.min(_name_of(F.col("doc_id"), F.col("key"), F.col("i"))).alias("name"), F.count(F.lit(1)).alias("c"))
        .where("c > 1")
        .drop("c"),
        "repeated-blocks",
    )
    named = blocks.join(names, "block", "left").select("doc_id", "key", "n", "i", "name")
    # Only documents all of whose blocks occur elsewhere too can equal another document.
    alone = F.max(F.col("name").isNull())
    level = written(
        named.groupBy("doc_id", "key", "n")
        .agg(alone.alias("alone"), F.sort_array(F.collect_set(F.struct("i", "name"))).alias("blocks"))
        .select("doc_id", "key", "n", "alone", F.when(~F.col("alone"), F.col("blocks.name")).alias("names")),
        "block-names",
    )
    own = _name_of(F.col("doc_id"), F.col("key"), F.lit(-1))
    done = level.where("alone or n = 1").select("doc_id", "key", F.when(F.col("alone"), own).otherwise(F.col("names")[0]).alias("name"), F.lit(1).alias("n"))
    todo = level.where("not alone and n > 1").select("doc_id", "key", "n", F.posexplode("names").alias("i", "name"))
    longest = level.where("not alone").agg(F.max("n")).first()[0] or 1
    none = _name_of(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(-2))
    width = longest
    while width > 1:
        pairs = todo.groupBy("doc_id", "key", "n", (F.col("i") / 2).cast("int").alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), none).alias("b"),
        )
        pairs = written(pairs, "block-pairs")
        of_pair = pairs.groupBy("a", "b").agg(F.min(_name_of(F.col("doc_id"), F.col("key"), F.col("i"))).alias("name"))
        todo = pairs.join(of_pair, ["a", "b"]).select("doc_id", "key", "n", "i", "name")
        width = (width + 1) // 2
    if longest > 1:
        done = done.unionByName(todo.select("doc_id", "key", "name", "n"))
    # n is 1 for what needed no recursion and the number of blocks otherwise: with the name, an identity.
    return done.select("doc_id", "key", F.struct("n", "name").alias("name"))


def _grouped(docs: DataFrame, block_bytes: int) -> DataFrame:
    """doc_id, key, keep_id, group_size, kept, text_sha256 of each row."""
    rows = docs.select(
        "doc_id",
        text_key().alias("key"),
        F.sha2(F.encode(normalised(), "UTF-8"), 256).alias("text_sha256"),
        F.length(F.coalesce(F.col("text"), F.lit(""))).alias("points"),
    )
    # A null doc_id is one more id; the struct keeps it apart from real ones in equality joins.
    name = identities(docs, block_bytes).select(F.struct("doc_id", "key").alias("id"), "name").distinct()
    rows = written(rows.withColumn("id", F.struct("doc_id", "key")).join(name, "id"), "block-identities")
    best = rows.groupBy("name").agg(
        F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id"), F.col("key"))).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    )
    out = rows.drop("id").join(written(best, "block-groups"), "name")  # written, as a group may be large
    first = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))
    return out.select("doc_id", "key", F.col("best.doc_id").alias("keep_id"), "group_size", first.alias("kept"), "text_sha256")


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every white-space character is deleted.  Of equal
    texts the row with the most code points in the original text stays, ties go to the
    smallest doc_id, then to the text of least hash.  Null texts are empty texts; all empty texts
    form one group.  Rows repeated in full each count in ``group_size`` and share ``kept``.  A
    null doc_id sorts before all others.  Further columns are ignored.
    """
    return _grouped(docs, block_bytes).drop("key")


def without_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, whole and in all columns, that stay: one of each group of equal texts, also
    where rows repeat a doc_id or repeat in full."""
    found = _grouped(docs, block_bytes).where("kept")
    return only(docs, found.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")))


def op10_exact_dedup(spark, sf_dir):
    from plumbline.llm.common import table

    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kept,
  sha256(norm) AS text_sha256
FROM t
"""
