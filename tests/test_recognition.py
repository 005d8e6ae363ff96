"""The recognition pipeline against a plain version of it, document by document."""

from __future__ import annotations

import re
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sableframe.operators import entities as e
from sableframe.operators import recognition as r

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests

NAMES = r"[A-Z][a-z]{2,} [a-z]{5,}"
PATTERNS = {"EMAIL": e.PATTERNS["EMAIL"], "IP_ADDRESS": e.PATTERNS["IP_ADDRESS"], "PHONE": e.PATTERNS["PHONE"]}


def spotted(text):
    """A stand-in for a model: capitalised words with the next one, as people or organisations, some out of place."""
    out = []
    for k, m in enumerate(re.finditer(NAMES, text)):
        kind = "ORG" if len(m[0]) % 3 == 0 else "PERSON"
        start = m.start() + (7 if k % 5 == 4 else 0)
        out.append((kind, m[0] + ("," if text[m.end() : m.end() + 1] == "," else ""), start, 0.5 + (k % 5) / 10 if k % 2 else None))
    return [(t, x, s, s + len(x), c) for t, x, s, c in out]


def model(parts):
    def run(batches):
        for pdf in batches:
            rows = [(d, c, *s) for d, c, text in zip(pdf["doc_id"], pdf["chunk"], pdf["text"]) for s in spotted(text)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "type", "text", "start", "end", "confidence"])

    return parts.mapInPandas(run, "doc_id long, chunk int, type string, text string, start long, end long, confidence double")


def plain_chunks(text, budget=1600, longest=320, most=12):
    lines, seen, after = [], set(), 0
    for p in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        p = p.strip()
        for x in [p] if len(p) <= 2 * longest else [y.strip() for y in re.split(r"(?<=[。；;])\s*", p)]:
            x = re.sub(r"\s+", " ", x).strip()
            if x and x not in seen:
                x = x[:longest].rstrip()
                at = text.find(x, after)
                at = text.find(x) if at < 0 else at
                after = at + len(x) if at >= 0 else after
                seen.add(x)
                lines.append((x, at))
    out = [[]]
    for x in lines:
        if out[-1] and sum(len(y) + 1 for y, _ in out[-1]) + len(x[0]) + 1 > budget:
            out.append([])
        out[-1].append(x)
    return [c for c in out[:most] if c]


def plain(text):
    """(type, text, start, end, source, propagated, coref, id) of a document, step by step."""
    found = []
    for chunk in plain_chunks(text):
        whole, starts, pos = "\n".join(x for x, _ in chunk), [], 0
        for x, _ in chunk:
            starts.append(pos)
            pos += len(x) + 1
        for t, x, s, end, c in spotted(whole):
            at = -1
            if 0 < s < len(whole):
                i = max(k for k, y in enumerate(starts) if y <= s)
                guess = chunk[i][1] + s - starts[i]
                at = guess if chunk[i][1] >= 0 and text[guess : guess + len(x)] == x else -1
            for _, o in chunk:
                if at < 0 <= o:
                    at = text.find(x, o, o + 320 + len(x))
            at = text.find(x) if at < 0 else at
            found.append([t, x, at if at >= 0 else s, at + len(x) if at >= 0 else end, "model", c])
    for t, p in PATTERNS.items():
        for m in re.finditer(p, text, re.I | re.A):
            if not any(m.start() < f[3] and m.end() > f[2] for f in found if f[4] == "model"):
                found.append([t, m[0], m.start(), m.end(), "regex", None])
    used, good = [], []
    for t, x, s, end, src, c in sorted(found, key=lambda f: (f[0] not in r.SEMANTIC or f[4] != "model", f[2], f[3], f[0])):
        if text[s:end] != x or not 0 <= s < end <= len(text):
            s = next((m.start() for m in re.finditer(re.escape(x), text) if not any(m.start() < b and m.end() > a for a, b in used)), -1)
        if s >= 0 and x.strip(r.EDGES):
            s, x = s + len(x) - len(x.lstrip(r.EDGES)), x.strip(r.EDGES)
            used.append((s, s + len(x)))
            good.append((t, x, s, s + len(x), src, c))

    def rank(f):
        return (-e.SOURCE_RANK[f[4]], -e.TYPE_PRIORITY.get(f[0], 1))

    place = {}
    for f in good:
        place.setdefault((f[2], f[3]), []).append(f)
    one = [min(fs, key=lambda f: (f[5] is None, -(f[5] or 0), *rank(f), f[0])) for fs in place.values()]
    groups, until = [], -1
    for f in sorted(one, key=lambda f: (f[2], f[3])):
        if f[2] >= until:
            groups.append([])
            until = f[3]
        until = max(until, f[3])
        groups[-1].append(f)
    kept = [min(g, key=lambda f: (-e.TYPE_PRIORITY.get(f[0], 1), -e.SOURCE_RANK[f[4]], f[5] is None, -(f[5] or 0), f[3] - f[2], f[2], f[0])) for g in groups]
    out, taken = [(*f, False) for f in kept], [(f[2], f[3]) for f in kept]
    for f in kept:
        if f[4] == "model":
            for m in re.finditer(re.escape(f[1]), text):
                if not any(m.start() < b and m.end() > a for a, b in taken):
                    taken.append((m.start(), m.end()))
                    out.append((f[0], f[1], m.start(), m.end(), "model", min(0.9, f[5] if f[5] is not None else 0.9), True))
    orgs = {f[1] for f in out if f[0] == "ORG"}

    def key(f):
        if f[0] != "ORG" or len(f[1]) < 4:
            return f[1]

        def share(a, b):
            at = hit = 0
            for ch in a:
                k = b.find(ch, at)
                at, hit = (k + 1, hit + 1) if k >= 0 else (at, hit)
            return hit / len(a)

        longer = [o for o in orgs if len(o) > len(f[1]) and share(f[1], o) >= 0.9]
        return max(longer, key=lambda o: (len(o), o)) if longer else f[1]

    first = {}
    for f in out:
        first[(key(f), f[0])] = min(first.get((key(f), f[0]), (True, 1 << 60)), (f[6], f[2]))
    number = {k: f"coref_{i + 1:03d}" for i, (k, _) in enumerate(sorted(first.items(), key=lambda x: x[1]))}
    done = sorted(out, key=lambda f: (f[2], f[3], f[0]))
    return [(f[0], f[1], f[2], f[3], f[4], f[6], number[(key(f), f[0])], f"entity_{i}") for i, f in enumerate(done)]


TEXTS = [
    (-1, None), (-2, ""), (-3, "  \n\r\n"), (-4, "Anna berry,  Anna\nberry Anna berry. Anna berry"), (-5, "Zoe   zebra and (Bob badger) Bob badger"),
    (-6, "Line one\nLine one\n" + "Acme industries of the north. " * 300 + "\nx@y.org 10.0.0.1"), (-7, "Acme industry\nAcme industryx; x" + "。" * 700 + "Bob badger；" * 90),
]


def test_recognition_equals_the_plain_version(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    found = r.recognised(docs, model, PATTERNS).select("doc_id", "type", "text", "start", "end", "source", "propagated", "coref_id", "entity_id").collect()
    want = [(d, *row) for d, text in docs.collect() for row in plain(text or "")]
    assert sorted(map(tuple, found)) == sorted(want) and len(want) > 500
    assert any(f["propagated"] for f in found)
    texts = {d: t for d, t in docs.collect()}
    assert all(texts[f["doc_id"]][f["start"] : f["end"]] == f["text"] for f in found)


def test_short_names_are_compared_without_white_space(spark):
    docs = spark.createDataFrame([(1, "The aning. Thenan ingor."), (2, "The aning. Thexan isgor.")], "doc_id long, text string")
    found = r.recognised(docs, model).where("type = 'ORG'").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("coref_id").alias("refs")).collect()
    assert sorted(map(tuple, found)) == [(1, 2, 1), (2, 2, 2)]


def test_chunks_equal_the_plain_version(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    for budget, longest, most in ((1600, 320, 12), (90, 40, 3)):
        found = {(c["doc_id"], c["chunk"]): c for c in r.chunks(docs, budget, longest, most).collect()}
        want = {(d, k): c for d, t in docs.collect() for k, c in enumerate(plain_chunks(t or "", budget, longest, most))}
        assert found.keys() == want.keys()
        for k, c in want.items():
            assert found[k]["text"] == "\n".join(x for x, _ in c) and found[k]["offsets"] == [o for _, o in c]


def test_without_a_model(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org, (2020) No.（12）x"), (2, None)], "doc_id long, text string")
    found = r.recognised(docs, None, {"EMAIL": e.PATTERNS["EMAIL"], "CASE_NUMBER": r"2020\) No"}).orderBy("start").collect()
    assert [(f["type"], f["text"], f["start"], f["source"], f["entity_id"], f["coref_id"]) for f in found] == [
        ("EMAIL", "a@b.org", 5, "regex", "entity_0", "coref_001"), ("CASE_NUMBER", "(2020) No", 14, "regex", "entity_1", "coref_002"),
    ]


@pytest.mark.parametrize("rows", [[]])
def test_of_nothing(spark, rows):
    assert r.recognised(spark.createDataFrame(rows, "doc_id long, text string"), model).count() == 0
    assert r.chunks(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.count("*")).first()[0] == 0
