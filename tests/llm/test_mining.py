"""Hard negatives, collocations and mixing against SQL, brute force and edge cases."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sableframe.llm import hard_negatives, mixing, phrases, registry
from sableframe.llm.perfect_hash import PerfectHash


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_phrases", "op13_mixing"])
def test_same_as_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    mine = registry.queries()[name](spark, data).select(*columns).collect()
    rows = found.fetchall()
    assert sorted(str(list(r)) for r in mine) == sorted(str(list(r)) for r in rows) and rows


VECTORS = "vec_id long, embedding array<float>, label int, anchor string, q int"


def brute_negatives(rows):
    taking = [(i, lab, tuple(math.floor(256 * float(x)) for x in v)) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for anchor in set(r for r in taking if r[0] is not None and r[0] % 50 == 0):
        def ranked(keep):
            some = [(sum(a * b for a, b in zip(anchor[2], r[2])), r[0]) for r in taking if keep(r)]
            return sorted(some, key=lambda s: (-s[0], s[1] is None, s[1] or 0))

        for p, pid in ranked(lambda r: r[1] == anchor[1] and r[0] != anchor[0])[:5]:
            good = [x for x in ranked(lambda r: r[1] != anchor[1]) if 50 * p <= 100 * x[0] <= 95 * p][:3]
            out += [(anchor[0], pid, k + 1, i, p, s) for k, (s, i) in enumerate(good)]
    return sorted(out, key=str)


def test_hard_negatives_edges(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [round(float(x), 2) for x in rng.normal(0.2, 0.3, 6)], int(rng.integers(0, 3))) for i in range(160)]
    rows += [(None, [0.5] * 6, 1), (200, None, 1), (201, [0.1, None], 1), (202, [math.inf] * 6, 1), (203, [math.nan] * 6, 1), (204, [0.3] * 6, None), (205, [], 2), (206, [0.9, 0.9], 0)]
    rows += [rows[3]] * 7 + [rows[50]] * 2 + [(i, [0.4] * 6, i % 3) for i in range(300, 340)]  # repeats, ties
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    whole = hard_negatives.whole(df, F.col("label"))
    for block, anchors in ((8192, 8192), (16, 2)):
        found = hard_negatives.mined(whole, F.col("vec_id") % 50 == 0, block=block, anchor_block=anchors).collect()
        assert sorted((tuple(r) for r in found), key=str) == brute_negatives(rows) and found
    assert hard_negatives.mined(whole.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_products_are_exact():
    for scale in (1, 2**26, 2**29, 2**31):
        a = np.array([[scale, -1, 3], [1, 2, 3]])
        assert hard_negatives.products(a, a).tolist() == [[sum(x * y for x, y in zip(r, s)) for s in a.tolist()] for r in a.tolist()]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 20_000))
    made = PerfectHash.of(keys[::2])
    again = PerfectHash.from_columns(made.to_columns())
    assert sorted(again.slots(keys[::2]).tolist()) == list(range(len(keys[::2])))  # minimal, without a gap
    assert (again.keys[again.slots(keys[::2])] == keys[::2]).all() and (again.slots(keys[1::2]) == -1).all()
    assert PerfectHash.of(np.zeros(0, np.int64)).slots(np.array([1, 2])).tolist() == [-1, -1]


def brute_phrases(docs, longest, least):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, own in f.items():
        some = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        for p, a in some.items():
            inside = any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in some.items())
            if not inside:
                score, _, left, right = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                out.append((lang, " ".join(p), a, left, right, n[lang], score))
    return sorted(out)


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_phrases_edges(spark, longest):
    rng = np.random.default_rng(3)
    words = ["A", "b", "É", "é", "|", "漢字", " x", "w\x00", "long" * 9]
    docs = [(("en", "de", None)[k % 3], "".join(words[i] + " \t .\n,"[j] for i, j in zip(rng.integers(0, 9, 90), rng.integers(0, 6, 90)))) for k in range(40)]
    docs += [("en", None), ("und", ""), ("fr", " .. \n"), ("en", "a a a a a a a a a a a a a a"), docs[0], docs[0], ("xx", "one two three " * 4_000)]
    df = spark.createDataFrame([(*d, "a", 1) for d in docs], "lang string, text string, word string, f int")
    found = phrases.Phrases(df, longest, shard_words=500).collocations().select("lang", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, found)) == brute_phrases(docs, longest, 10) and len(found) > 20


def test_phrases_of_nothing(spark):
    assert phrases.ranked_collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.ranked_collocations(spark.createDataFrame([("en", None)], "lang string, text string")).count() == 0


def test_word_codes_on_long_texts():
    codes, words = phrases.word_codes([("Ab cd. " * 300_000).encode(), b""])
    assert len(words) == 2 and (codes >= 0).sum() == 600_000 and (codes == -1).sum() == 299_999


def test_mixing_edges(spark):
    rng = np.random.default_rng(9)
    docs = [(i, "w " * int(rng.integers(1, 80)), f"s{i % 4}") for i in range(400)]
    docs += [(None, "a b", None), (401, None, "s1"), (402, "", None), (403, "x " * 30_000, "big"), (404, "y " * 9, None)] + [docs[7]] * 50
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, size int, number int")
    rows = mixing.mixed(df).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixed(df.repartition(3)).collect()))  # reruns agree
    assert len(rows) == len(docs)
    sizes, weigh = Counter(), {}
    for _, text, source in docs:
        sizes[source] += len((text or "").split())
    for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weigh[s] = (5, 2, 1)[k % 3]
    full = set()
    while True:
        free = sum(sizes.values()) - 3 * sum(sizes[s] for s in full)
        goal = {s: 3 * sizes[s] if s in full else weigh[s] * free / sum(weigh[x] for x in sizes if x not in full) for s in sizes}
        over = {s for s in sizes if s not in full and goal[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    source = {d[0]: d[2] for d in docs}
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], goal[s]) and r["taken"] <= 3 * r["size"]
    for s in sizes:
        if s != "big":
            assert abs(taken[s] - goal[s]) <= max(2, 0.02 * goal[s]), s
    assert mixing.mixed(df.limit(0)).count() == 0


def test_pareto_chances(spark):
    """Over many seeds a text is taken about as often as its chance says."""
    df = spark.createDataFrame([(i, "w " * (3 + 13 * (i % 3)), "a" if i % 2 else "b") for i in range(240)], "doc_id long, text string, source string")
    total = Counter()
    for seed in range(4):
        for r in mixing.mixed(df, weights=(1, 3), seed=str(seed)).collect():
            total[(r["source_size"], r["target"], r["size"])] += r["taken"] / r["size"] / 4 / 40
    copies = dict(total)
    for (_, target, size), mean in copies.items():
        words = sum(s * 40 for s in (3, 16, 29))
        rate = target / sum(s.bit_length() * s * 40 for s in (3, 16, 29))
        assert abs(mean - rate * size.bit_length()) < 0.2, (target / words, size, mean)


def test_lm_starts_from_all_training_texts(spark):
    import numpy as np

    from sableframe.llm import lm_scoring as lm
    from sableframe.llm.common import crc_mod

    docs = spark.createDataFrame([(i, f"word{i % 7} and other{i % 11} things {'so ' * (i % 5)}") for i in range(5000)], "doc_id long, text string")
    model, _ = lm.fit(docs)
    found, model.start = model.start, lm.Start()
    want = lm.trained_start(docs.where(crc_mod(docs["doc_id"], lm.FOLDS) != lm.HELD_OUT), model)
    assert np.array_equal(found.weights, want.weights) and np.array_equal(found.refine, want.refine)
