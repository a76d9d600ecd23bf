"""Merkle dataset manifest: a tree of hashes for each source, one over all, and a proof for each row.

Leaves are range-sorted by source and id into an RDD that is checkpointed, so every later pass sees the same
partitions.  What the driver gets of it is an entry for each partition: the groups at its two ends and their
counts.  From these follow the offset of each partition's first leaf in its group and the group's size.  A
partition then builds all subtrees whose leaves it holds; nodes whose siblings lie elsewhere (at most two
at each end of each level) are shuffled by coordinate, some levels at a time, so that one group of the shuffle
has at most ``ARITY ** STEP`` of them.  The subroots are the leaves of the upper tree, which is finished alike.
Proofs go the other way: the path above a shuffled node is joined from the top down, and a partition puts
the part within its own subtrees in front.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import groupby

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import partitions, ship, table, written
from plumbline.sources.tables import deleted_at_exit, run_folder

#: Children of a node, levels that one shuffle climbs, and leaves of a partition (on average, at most).
ARITY, STEP, LEAVES = 3, 6, 200_000
PROOF = "array<struct<place:int,siblings:array<string>>>"

# A coordinate is (group, level, index), a node (coordinate, (leaves of the group, hash)), a path a list of
# (place among its siblings, their hashes), from a node upward.


def digest(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def width(total: int, level: int) -> int:
    """Nodes of a level over ``total`` leaves."""
    return -(-total // ARITY**level)


def height(total: int) -> int:
    """The level that has one node."""
    level = 0
    while width(total, level) > 1:
        level += 1
    return level


def climbed(hashes: list[str], first: int, total: int) -> list[tuple[int, list[str]]]:
    """For each level the nodes that the leaves from ``first`` on make complete: (index of the first, hashes)."""
    levels = [(first, hashes)]
    for level in range(height(total)):
        lo, row = levels[-1]
        hi = lo + len(row)
        start = -(-lo // ARITY)
        stop = width(total, level + 1) if hi == width(total, level) else hi // ARITY
        if start >= stop:
            break
        levels.append((start, [digest(row[ARITY * p - lo : ARITY * (p + 1) - lo]) for p in range(start, stop)]))
    return levels


def without_parent(levels: list[tuple[int, list[str]]]) -> Iterator[tuple[int, int, str]]:
    """level, index, hash of the nodes whose parent isn't complete."""
    for level, (lo, row) in enumerate(levels):
        start, above = levels[level + 1] if level + 1 < len(levels) else (0, [])
        head = min(ARITY * start - lo, len(row)) if above else len(row)
        tail = min(ARITY * (start + len(above)) - lo, len(row)) if above else len(row)
        for k in (*range(head), *range(tail, len(row))):
            yield level, lo + k, row[k]


def path_within(levels: list[tuple[int, list[str]]], index: int) -> tuple[int, int, list]:
    """level and index of the topmost complete node over a leaf, and the path to it."""
    level, path = 0, []
    while level + 1 < len(levels):
        lo, row = levels[level]
        start, above = levels[level + 1]
        parent = index // ARITY
        if not start <= parent < start + len(above):
            break
        run, place = row[ARITY * parent - lo : ARITY * (parent + 1) - lo], index - ARITY * parent
        path.append((place, run[:place] + run[place + 1 :]))
        level, index = level + 1, parent
    return level, index, path


def climb_block(nodes: Iterable, top: int) -> Iterator[tuple]:
    """Of the nodes below one node of level ``top`` (or the root, if that is lower): that node, and for each of them
    (coordinate, (that node's coordinate, path to it))."""
    nodes = list(nodes)
    (group, _, _), (total, _) = nodes[0]
    top = min(top, height(total))
    rows: dict[int, dict[int, str]] = {}
    for (_, level, index), (_, h) in nodes:
        rows.setdefault(level, {})[index] = h
    for level in range(min(rows), top):
        row = rows.get(level, {})
        for parent in {i // ARITY for i in row}:
            rows.setdefault(level + 1, {})[parent] = digest(row[i] for i in range(ARITY * parent, min(ARITY * (parent + 1), width(total, level))))
    for coordinate, _ in nodes:
        _, level, index = coordinate
        path = []
        for at in range(level, top):
            parent = index // ARITY
            run = range(ARITY * parent, min(ARITY * (parent + 1), width(total, at)))
            path.append((index - ARITY * parent, [rows[at][i] for i in run if i != index]))
            index = parent
        yield True, (coordinate, ((group, top, index), path))
    (index,) = rows[top]
    yield False, ((group, top, index), (total, rows[top][index]))


def _below(node, top: int) -> bool:
    (_, level, _), (total, _) = node
    return level < min(top, height(total))


def _block(node, top: int):
    (group, level, index), _ = node
    return (group, index // ARITY ** (top - level)), node


def _round(nodes: RDD, top: int, n: int) -> tuple[RDD, RDD]:
    """The nodes after climbing to ``top``, and the step of each node before."""
    climbing = nodes.filter(lambda x: _below(x, top)).map(lambda x: _block(x, top)).groupByKey(n).flatMap(lambda x: climb_block(x[1], top))
    resting = nodes.filter(lambda x: not _below(x, top))
    steps = climbing.filter(lambda x: x[0]).map(lambda x: x[1]).union(resting.map(lambda x: (x[0], (x[0], []))))
    return climbing.filter(lambda x: not x[0]).map(lambda x: x[1]).union(resting), steps


def finished(nodes: RDD, levels: int, n: int) -> tuple[RDD, list[RDD]]:
    """The roots over nodes whose groups have at most so many levels, and the steps of each round."""
    steps = []
    for top in range(STEP, levels + STEP, STEP):
        nodes, step = _round(nodes, top, n)
        steps.append(step)
    return nodes, steps


def descended(steps: list[RDD], above: RDD, n: int) -> RDD:
    """(coordinate, (path, note)) of the nodes that the first round began with, from those of the last."""
    for step in reversed(steps):
        by_parent = step.map(lambda x: (x[1][0], (x[0], x[1][1])))
        above = by_parent.join(above, n).map(lambda x: (x[1][0][0], (x[1][0][1] + x[1][1][0], x[1][1][1])))
    return above


def _ends(pid: int, rows: Iterable) -> Iterator[tuple]:
    """(partition, groups in it, first group and its leaves, last group and its leaves)."""
    runs = first = last = None
    for key, of in groupby(rows, key=lambda r: r[0]):
        last = (key, sum(1 for _ in of))
        runs, first = (runs or 0) + 1, first or last
    if runs:
        yield pid, runs, first, last


def offsets(ends: list[tuple]) -> tuple[dict[int, tuple[int, int, int, int]], int, int]:
    """For each partition the number of its first group, the place of its first leaf there, and the sizes of its first
    and last group; the number of groups; the size of the largest group that goes over partitions."""
    at: dict[int, tuple[int, int, int]] = {}
    sizes: dict[int, int] = {}
    group, key, spread = -1, object(), 0
    for pid, runs, first, last in sorted(ends):
        if first[0] != key:
            group += 1
        place = sizes.get(group, 0)
        spread = max(spread, place and place + first[1])
        sizes[group] = place + first[1]
        at[pid] = (group, place, group + runs - 1)
        if runs > 1:
            group, key = group + runs - 1, last[0]
            sizes[group] = last[1]
        else:
            key = first[0]
    return {pid: (g, place, sizes[g], sizes[z]) for pid, (g, place, z) in at.items()}, group + 1, spread


def _groups(rows: Iterable, info: tuple[int, int, int, int]) -> Iterator[tuple]:
    """group, place of its first leaf here, its size, its rows."""
    number, place, size, last_size = info
    held = None
    for k, (_, of) in enumerate(groupby(rows, key=lambda r: r[0])):
        if held is not None:
            yield held
        of = list(of)
        held = (number + k, place, size, of) if k == 0 else (number + k, 0, len(of), of)
    if held is not None:
        number, place, size, of = held
        yield number, place, last_size, of


def ranged(rows: DataFrame, n: int) -> RDD:
    """source, doc_id, leaf, tampered leaf, range-sorted by source and doc_id, nulls first and strings by their
    bytes.  Rows that agree in all of these are dealt out too."""
    sc = rows.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(run_folder(rows.sparkSession))
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf", "tampered", "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    out = dealt.select("source", "doc_id", "leaf", "tampered").rdd.map(tuple)
    out.checkpoint()
    return out


def leaves(docs: DataFrame) -> DataFrame:
    """source, doc_id, leaf, tampered: the hash of each row, and of what tampering leaves of it."""

    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    def leaf(text: Column) -> Column:
        return F.sha2(F.concat(*[part(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], part(text)), 256)

    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)) & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    return docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("leaf"), F.when(changed, leaf(F.replace("text", F.lit("\n"), F.lit("")))).alias("tampered"))


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, leaf, tampered (the leaf after tampering, null where that changes
    nothing), subroot, root, proof (place among siblings and their hashes, level by level from leaf to root).

    Leaves ascend by doc_id within a source, null first; rows that share both by their hashes, so repeated rows
    are leaves of their own.  Null fields, sources and ids are hashed as ``-``; a row with a null id isn't tampered
    with.  An empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = written(leaves(docs), "leaves")
    n = partitions(spark)
    sorted_rows = ranged(rows, max(n, -(-rows.count() // LEAVES)))
    n_parts = sorted_rows.getNumPartitions()
    info, n_groups, spread = offsets(sorted_rows.mapPartitionsWithIndex(_ends).collect())
    if (file := sorted_rows.getCheckpointFile()) is not None:
        deleted_at_exit(spark, file)

    def ragged(pid: int, of: Iterable) -> Iterator[tuple]:
        if pid in info:
            for group, place, size, part in _groups(of, info[pid]):
                for level, index, h in without_parent(climbed([r[2] for r in part], place, size)):
                    yield (group, level, index), (pid, size, h)

    sent = sorted_rows.mapPartitionsWithIndex(ragged)
    nodes = sent.mapValues(lambda x: x[1:])
    subroots, steps = finished(nodes, height(spread), n)
    upper = subroots.map(lambda x: ((0, 0, x[0][0]), (n_groups, x[1][1])))
    root, upper_steps = finished(upper, height(n_groups), n)
    above = descended(upper_steps, root.map(lambda x: (x[0], ([], x[1][1]))), n)
    # The path above a subroot, and the two roots, by its coordinate.
    tops = subroots.map(lambda x: (x[0][0], (x[0], x[1][1]))).join(above.map(lambda x: (x[0][2], x[1])), n)
    paths = descended(steps, tops.map(lambda x: (x[1][0][0], (x[1][1][0], (x[1][0][1], x[1][1][1])))), n)
    by_part = sent.mapValues(lambda x: x[0]).join(paths, n).map(lambda x: (x[1][0], (x[0], x[1][1]))).partitionBy(n_parts, lambda pid: pid)

    def proved(pid: int, pair: Iterable) -> Iterator[tuple]:
        for of, known in pair:
            known = {coordinate: x for _, (coordinate, x) in known}
            for group, place, size, part in _groups(of, info[pid]) if pid in info else ():
                levels = climbed([r[2] for r in part], place, size)
                for k, (source, doc_id, leaf, tampered) in enumerate(part):
                    level, index, path = path_within(levels, place + k)
                    above, (subroot, root) = known[group, level, index]
                    yield doc_id, source, leaf, tampered, subroot, root, path + above

    out = sorted_rows.glom().zip(by_part.glom()).mapPartitionsWithIndex(proved)
    kind = "doc_id long, source string, leaf string, tampered string, subroot string, root string, proof " + PROOF
    return spark.createDataFrame(out, kind, verifySchema=False)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to, by built-in functions alone."""

    def step(h: Column, x: Column) -> Column:
        before = F.array_join(F.slice(x["siblings"], F.lit(1), x["place"]), "")
        behind = F.array_join(F.slice(x["siblings"], x["place"] + 1, F.size(x["siblings"])), "")
        return F.sha2(F.concat(before, h, behind), 256)

    return F.aggregate(proof, leaf, step)


def op11_merkle(spark, sf_dir):
    m = manifest(table(spark, sf_dir, "documents"))
    hashes = F.array_join(F.flatten(F.transform("proof", lambda x: x["siblings"])), "")
    out = m.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(hashes, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The table of bytes of CRC-32, and the check sum of an ASCII text; DuckDB has none of its own.
CRC_TABLE = """crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"""
CRC_OF_BYTES = "xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295)"
_PART = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
leaf AS (SELECT doc_id, source, {_LEAF.format("text")} AS leaf, {_LEAF.format("replace(text, chr(10), '')")} AS stripped,
  {CRC_OF_BYTES.format(bytes="list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 2 = 0 AS hit FROM documents, crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS r FROM leaf),
low AS (SELECT 0 AS lv, source, i, leaf AS h FROM placed UNION ALL
  SELECT lv + 1, source, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM low) WHERE n > 1 GROUP BY lv, source, i // 3),
subs AS (SELECT source, max(lv) AS high, arg_max(h, lv) AS subroot FROM low GROUP BY source),
tops AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM subs),
up AS (SELECT 0 AS lv, g AS i, subroot AS h FROM tops UNION ALL
  SELECT lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM up) WHERE n > 1 GROUP BY lv, i // 3),
crown AS (SELECT max(lv) AS top, arg_max(h, lv) AS root FROM up),
own AS (SELECT r, lv, placed.source, CAST(i // CAST(pow(3, lv) AS BIGINT) AS BIGINT) AS pos FROM placed JOIN subs ON placed.source IS NOT DISTINCT FROM subs.source, range(high) AS x(lv)
  UNION ALL SELECT r, 1000 + lv, NULL, CAST(g // CAST(pow(3, lv) AS BIGINT) AS BIGINT) AS pos FROM placed JOIN tops ON placed.source IS NOT DISTINCT FROM tops.source, crown, range(top) AS x(lv)),
every AS (SELECT lv, source, i, h FROM low UNION ALL SELECT 1000 + lv, NULL, i, h FROM up),
step AS (SELECT r, own.lv, coalesce(string_agg(h, '' ORDER BY i) FILTER (WHERE i < pos), '') AS before, coalesce(string_agg(h, '' ORDER BY i) FILTER (WHERE i > pos), '') AS behind
  FROM own JOIN every ON own.lv = every.lv AND own.source IS NOT DISTINCT FROM every.source AND pos // 3 = i // 3 GROUP BY r, own.lv),
path AS (SELECT r, string_agg(before || behind, '' ORDER BY lv) AS proof, list(before || '|' || behind ORDER BY lv) AS steps FROM step GROUP BY r),
out AS (SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256,
  list_reduce(list_prepend(CASE WHEN hit THEN stripped ELSE leaf END, coalesce(steps, [])), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
  FROM placed JOIN subs ON placed.source IS NOT DISTINCT FROM subs.source LEFT JOIN path USING (r), crown)
SELECT *, folded_root = root AS verified FROM out
"""
