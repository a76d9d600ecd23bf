"""Licence scans: rules and gates, resolution of overlaps, the query against a plain version."""

import random
import re
import re._parser as parser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import licenses
from plumbline.llm.common import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_base(text):
    """n_words, n_base, first, last, labels as the contract has them."""
    w = plain_words(text)
    found = sorted((i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))


def plain_resolved(found):
    kept = []
    for k, a, b in found:
        kept.append(not any(s and x[1] <= a and b <= x[2] for x, s in zip(found, kept)))
    return kept


def plain_labels(text):
    """Labels and score with every rule tried and every pair of detections compared."""
    line = " ".join(plain_words(text)).encode("utf-8", "surrogatepass")
    found = []
    for k, r in enumerate(licenses.rules()):
        found += [(k, line[: m.start()].count(b" "), line[: m.end()].count(b" ") + 1) for m in r.pattern.finditer(line)]
    found.sort(key=lambda x: (x[0], x[1], -x[2]))
    best = {}
    for (k, _, _), stays in zip(found, plain_resolved(found)):
        r = licenses.rules()[k]
        if stays:
            best[r.label] = max(best.get(r.label, 0), r.strength)
    for label in filter(None, plain_base(text)[4].split(",")):
        best[label] = max(best.get(label, 0), 0.6)
    doubt = 1.0
    for x in best.values():
        doubt *= 1 - x
    return ",".join(sorted(best)), 1 - doubt


def written(pattern, draw):
    """A text that an expression matches."""
    out = []
    for op, arg in pattern:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(arg))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            lo, hi, sub = arg
            out += [written(sub, draw) for _ in range(draw.randint(lo, min(int(hi), lo + 3)))]
        elif name == "SUBPATTERN":
            out.append(written(arg[3], draw))
        elif name == "BRANCH":
            out.append(written(draw.choice(arg[1]), draw))
        elif name == "IN":
            kind, value = draw.choice(arg)
            out.append(chr(value) if str(kind) == "LITERAL" else "7" if "DIGIT" in str(value) else "x")
        elif name in ("ASSERT", "ASSERT_NOT"):
            continue
        else:
            raise ValueError(name)
    return "".join(out)


def test_rules_are_hundreds_and_their_gates_lose_no_match():
    of, draw = licenses.rules(), random.Random(5)
    assert len(of) >= 250 and all(0 < r.strength < 1 for r in of)
    for r in of:
        tree = parser.parse(r.pattern.pattern.decode())
        for _ in range(40):
            text = written(tree, draw).encode()
            assert r.pattern.fullmatch(text), (r.label, text)
            assert r.gate <= set(text.split()), (r.label, text)
            assert text == b" ".join(text.translate(licenses.WORDS).split()), (r.label, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 12), st.integers(1, 8)), max_size=25))
def test_overlaps_are_resolved_as_pairs_are(found):
    found = sorted(((k, a, a + n) for k, a, n in found), key=lambda x: (x[0], x[1], -x[2]))
    assert licenses.resolved(found) == plain_resolved(found)


ODD = [
    (1, None), (2, ""), (3, " \n"), (4, "MIT License"), (5, "xMIT License"), (6, "mit. LICENSE, mit license"), (7, "cc by cc by cc"), (8, "CC BY-NC-SA 4.0"),
    (9, "GNU General Public License, version 2 or later; GNU General Public License"), (10, "spdx-license-identifier: Apache-2.0"), (11, "ÀMIT license é"), (12, "İ mit\x00license"),
    (13, "Licensed under the Apache License, Version 2.0. " * 3000), (14, "word " * 200_000 + "cc by"), (15, "All rights reserved. Tous droits réservés."), (16, "gnu general public\nlicense v3"),
]


def test_edges(make, spark):
    got = {r.doc_id: r for r in licenses.license_scan(make(ODD)).collect()}
    for i, text in ODD:
        r = got[i]
        base = [s for s in r.spans if s.rule < 0]
        starts = [s.start for s in base]
        assert (r.n_words, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({s.label for s in base}))) == plain_base(text)
        if len(text or "") < 20_000:
            labels, score = plain_labels(text)
            assert (",".join(sorted({s.label for s in r.spans if s.kept})), pytest.approx(score)) == (labels, r.score)
    assert {s.label for s in got[8].spans if s.kept} == {"cc-by", "cc-by-nc-sa-4.0"}
    assert {s.label for s in got[9].spans if s.kept} == {"gpl", "gpl-2.0-or-later"}
    assert sum(s.rule < 0 for s in got[13].spans) == 3000 and {s.label for s in got[13].spans if s.kept} == {"apache", "apache-2.0"}
    assert licenses.license_scan(make([])).count() == 0
    assert licenses.license_scan(make([(None, "mit license"), (4, "mit license"), (4, "mit license")])).count() == 3


def test_query_matches_a_plain_version(spark, sf_dir):
    got = {r.doc_id: r for r in licenses.op12_licenses(spark, sf_dir).collect()}
    docs = table(spark, sf_dir, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        labels, score = plain_labels(d.text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(d.text)
        assert (r.labels, r.score) == (labels, pytest.approx(score))
