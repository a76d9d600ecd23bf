"""License scans: ordered signature rules behind a keyword prefilter.

A text becomes lower-case words with one space between.  Which rules are tried follows from the words that a text
holds: each rule names words that all of its matches have.  Every match is a detection, an interval of words.
Detections are taken in the order of their rules; one that lies within the interval of a detection taken
before is suppressed, so "gnu general public license version 2" isn't also reported as a shorter mention within
it.  Places of the base phrases are always reported.

Everything is local to a row: no shuffle, and a text of any length is read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORDS, small_batches, table
from plumbline.llm.license_rules import BASE, RULES

SPAN = "struct<label:string,rule:int,start:long,stop:long,kept:boolean>"


@dataclass(frozen=True)
class Rule:
    """``strength``: how sure a match makes its label, from 0 to 1; ``gate``: words that every match has."""

    label: str
    strength: float
    gate: frozenset[bytes]
    pattern: re.Pattern[bytes]


def _compiled(expression: str) -> re.Pattern[bytes]:
    return re.compile(rb"(?<![^ ])(?:" + expression.encode() + rb")(?![^ ])")


@cache
def rules(text: str = RULES) -> list[Rule]:
    """Rules in order of priority, of lines ``label | percent | words | expression``."""
    out = []
    for line in text.strip().splitlines():
        label, percent, gate, expression = (x.strip() for x in line.split("|", 3))
        out.append(Rule(label, int(percent) / 100, frozenset(gate.encode().split()), _compiled(expression)))
    return out


@cache
def base_rules(text: str = BASE) -> list[Rule]:
    """The base phrases, of lines ``label | phrase``."""
    out = []
    for line in text.strip().splitlines():
        label, phrase = (x.strip() for x in line.split("|"))
        out.append(Rule(label, 0.6, frozenset(phrase.encode().split()), _compiled(re.escape(phrase))))
    return out


@cache
def by_gate(of: tuple[Rule, ...]) -> dict[bytes, list[int]]:
    """Rules by the longest word of their gate: those that a text without it doesn't ask for."""
    out: dict[bytes, list[int]] = {}
    for k, r in enumerate(of):
        out.setdefault(max(r.gate, key=lambda w: (len(w), w)), []).append(k)
    return out


def resolved(found: list[tuple[int, int, int]]) -> list[bool]:
    """Which detections (rule, start, stop) stay: in order of rule, start and length, those that don't lie within one
    that stays.  ``found`` is in that order."""
    kept: list[bool] = []
    held: list[tuple[int, int]] = []  # intervals that stay, but for those within a later one: stops ascend with starts
    for _, a, b in found:
        k = bisect_right(held, (a, float("inf")))
        inside = k > 0 and held[k - 1][1] >= b
        kept.append(not inside)
        if not inside:
            least = k - (k > 0 and held[k - 1][0] == a)
            while k < len(held) and held[k][1] <= b:
                k += 1
            held[least:k] = [(a, b)]
    return kept


def detections(data: bytes, of: tuple[Rule, ...], base: tuple[Rule, ...]) -> tuple[int, list[tuple], float]:
    """Words of a normalised text, its detections (label, rule, start, stop, kept) and its score.  Base phrases
    have rules below 0 and always stay."""
    words = data.split()
    present = set(words)
    gated = [k for w, at in by_gate(of).items() if w in present for k in at if of[k].gate <= present]
    first = [(k - len(base), r) for k, r in enumerate(base) if r.gate <= present]
    if not gated and not first:
        return len(words), [], 0.0
    line = b" ".join(words)
    ends = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)

    def places(r: Rule):
        spans = np.array([m.span() for m in r.pattern.finditer(line)], np.int64).reshape(-1, 2)
        return np.searchsorted(ends, spans[:, 0]).tolist(), (np.searchsorted(ends, spans[:, 1] - 1) + 1).tolist()

    out = [(r.label, k, a, b, True) for k, r in first for a, b in zip(*places(r))]
    found = sorted(((k, a, b) for k in gated for a, b in zip(*places(of[k]))), key=lambda x: (x[0], x[1], -x[2]))
    out += [(of[k].label, k, a, b, stays) for (k, a, b), stays in zip(found, resolved(found))]
    strongest: dict[str, float] = {}
    for label, k, _, _, stays in out:
        if stays:
            strongest[label] = max(strongest.get(label, 0.0), of[k].strength if k >= 0 else base[k].strength)
    doubt = 1.0
    for label in sorted(strongest):
        doubt *= 1.0 - strongest[label]
    return len(words), out, 1.0 - doubt


def license_scan(docs: DataFrame, rule_text: str = RULES, base_text: str = BASE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans (label, rule, start and stop in words, kept; base phrases
    have rules below 0), score.

    The score is 1 minus the product of the doubts of all labels that stay, each by its strongest detection; 0
    without any.  Null and empty texts have no words and no spans.  Repeated rows and null ids give a row each;
    further columns are ignored.
    """
    small_batches(docs.sparkSession)

    def scan(batches):
        of, base = tuple(rules(rule_text)), tuple(base_rules(base_text))
        for b in batches:
            rows = [detections(t.encode("utf-8", "surrogatepass").translate(WORDS) if isinstance(t, str) else b"", of, base) for t in b["text"]]
            spans = [[dict(zip(("label", "rule", "start", "stop", "kept"), s)) for s in r[1]] for r in rows]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_words": [r[0] for r in rows], "spans": spans, "score": [r[2] for r in rows]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(scan, f"doc_id long, n_words long, spans array<{SPAN}>, score double")


def op12_licenses(spark, sf_dir):
    found = license_scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rule"] < 0)
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.filter("spans", lambda s: s["kept"])).alias("labels"),
        "score",
    )
