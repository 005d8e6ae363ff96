"""Short names of organisations and the full ones they mean, against comparing all pairs."""

from __future__ import annotations

import random

from sableframe.operators import organisations as o
from sableframe.operators.entities import subsequence_share


def all_pairs(names, least=0.9):
    key = {x: "".join(x.split()).strip(o.ALIAS_EDGES) for x in names}
    share = subsequence_share.func
    out = {}
    for a in names:
        longer = [b for b in names if key[b] and len(b) > len(a) and share([key[a]], [key[b]])[0] >= least] if len(key[a]) >= o.ALIAS_LEAST else []
        if longer:
            out[a] = max(longer, key=lambda b: (len(b), b))
    return out


def test_aliases_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(o, "SHARE_NAMES", 150)
    rng = random.Random(5)
    docs = {d: {"".join(rng.choice("abcd漢é (") for _ in range(rng.randrange(1, 15))) for _ in range(n)} for d, n in ((1, 700), (2, 40), (3, 1))}
    docs[4] = {f"{s} works {k} limited" for s in ("BUILDING", "HOUSE") for k in range(200)} | {f"({s} works {k})" for s in ("BUILDIN", "HOUS") for k in range(0, 200, 3)}
    rows = [(d, x) for d, own in docs.items() for x in own] + [(2, None), (None, "abcd"), (None, "abcde"), (2, " ")]
    found = o.alias_links(spark.createDataFrame(rows + rows[:50], "doc_id long, text string")).collect()
    want = {(d, a, b) for d, own in docs.items() for a, b in all_pairs(own).items()}
    assert len(found) == len(want) > 400 and {tuple(r) for r in found} == want


def test_aliases_of_a_large_document_meet_few_names(monkeypatch):
    tried, within = [], o._within
    monkeypatch.setattr(o, "_within", lambda *x: tried.append(1) or within(*x))
    names = [f"{s} works {k} limited" for s in ("BUILDING", "HOUSEHOLD", "FURNITURE") for k in range(10_000, 12_000)] + [f"(BUILDIN works {k})" for k in range(10_000, 12_000)]
    found = dict(o._fulls(names, [x.replace(" ", "").strip("()") for x in names], [True] * len(names), 0.9))
    assert all(f"(BUILDIN works {k})" in found for k in range(10_000, 12_000)) and len(tried) < 20 * len(names)
