"""Training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sableframe.llm import bpe, common, license_scan, lm_scoring, media, near_duplicates, packing, quality_classifier, quality_rules, registry, toxicity, url_filters

DOCS = "doc_id long, text string"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n=120):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[k] for k in rng.integers(0, len(WORDS), n))


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, prose(1)), (6, prose(1)), (None, prose(2)), (7, prose(3, 30_000)), (8, "é ü 漢字 \x00 a"), (8, "é ü 漢字 \x00 a")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in EDGES], f"{DOCS}, key string, place int")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", ["op3_url_filters", "op7_license_scan", "op9_quality_rules"])
def test_same_as_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    mine = registry.queries()[name](spark, data).select(*columns).collect()
    assert sorted(str(list(r)) for r in mine) == sorted(str(list(r)) for r in found.fetchall())


def test_license_passages_of_many_cue_lines(spark):
    """One header around all of them and each line alone, in seconds."""
    text = "\n".join(f"copyright x {i}" for i in range(100_000))
    rows = license_scan.passages(spark.createDataFrame([(1, "a/b.py", text), (2, "a/c.py", "x\nlicense\n" + "y\n" * 20 + "spdx\n\nz")], "file_id long, path string, text string"))
    assert rows.where("file_id = 1").count() == 100_001
    few = {r["passage"]: r["text"] for r in rows.where("file_id = 2").collect()}
    lines = ["x", "license", *["y"] * 20, "spdx", "", "z"]
    around = license_scan.AROUND
    want = {1: "\n".join(lines[0 : 2 + around]), 22 - around + 1: "\n".join(lines[22 - around : 23 + around]), -2: "license", -23: "spdx"}
    assert few == want


def test_packing(edges, nothing):
    rows = packing.packed(edges).collect()
    assert packing.packed(nothing).count() == 0
    bins = {}
    for r in rows:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
    for own in bins.values():
        used = sum(r["n_tokens"] for r in own)
        assert own[0]["bin_capacity"] == next(c for c in packing.CAPACITIES if c >= used)
        at = 0
        for r in sorted(own, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["n_tokens"]
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["n_tokens"]
    assert total[7] == 30_000 and total[1] == total[2] == total[3] == 0 and total[8] == 10
    assert sum(total.values()) == sum(len((t or "").split()) for _, t in EDGES)


def test_packing_is_best_fit():
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in rng.integers(1, 4096, 300)]
    capacities = packing.CAPACITIES
    open_bins, want, used, left, last = [], {}, Counter(), sum(sizes), {}
    for turn, i in enumerate(sorted(range(len(sizes)), key=lambda k: -sizes[k])):
        # The least room; of equal ones the bin that was filled last.
        fits = [(room, -last[b], b) for b, room in enumerate(open_bins) if room >= sizes[i]]
        if fits:
            b = min(fits)[2]
        else:
            c = min((c for c in capacities if c >= sizes[i]), key=lambda c: (packing.cost(c) / max(1, min(c, left)), c))
            b = len(open_bins)
            open_bins.append(c)
        last[b] = turn
        want[i] = (b, used[b])
        open_bins[b] -= sizes[i]
        used[b] += sizes[i]
        left -= sizes[i]
    found = packing.pack(sizes)
    assert [(b, at) for b, at, _ in found] == [want[i] for i in range(len(sizes))]
    assert all(c == next(x for x in capacities if x >= used[b]) for b, _, c in found)


def test_packing_chooses_and_shrinks():
    # Many short texts share bins of a middle size, though each would fit the smallest.
    many = packing.pack([100] * 200)
    assert {c for _, _, c in many[:-20]} == {2048}
    # What is left at the end opens less, and a bin that stays half empty shrinks.
    assert packing.pack([100]) == [(0, 0, 512)]
    assert packing.pack([1500, 1500, 1500, 400])[2][2] == 2048 and packing.pack([600, 300])[0][2] == 1024


def least_cost(sizes):
    """The least cost of all ways to place the sizes, by search."""
    best = math.inf
    price = {n: packing.cost(next(c for c in packing.CAPACITIES if c >= n)) for n in range(1, max(packing.CAPACITIES) + 1)}

    def place(k, bins):
        nonlocal best
        if k == len(sizes):
            best = min(best, sum(price[n] for n in bins))
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] in price:
                place(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


def test_packing_is_near_the_least_cost():
    ratios = []
    for seed in range(30):
        sizes = [int(x) for x in np.random.default_rng(seed).integers(50, 2500, 6)]
        bins = {b: c for b, _, c in packing.pack(sizes)}
        ratios.append(sum(map(packing.cost, bins.values())) / least_cost(sizes))
    assert min(ratios) >= 1 - 1e-9 and max(ratios) < 1.4 and np.mean(ratios) < 1.12


def test_sequences_hold_the_token_ids(spark):
    docs = spark.createDataFrame([(i, prose(i, 30 + 17 * i)) for i in range(30)] + [(50, prose(50, 6000)), (51, "")], DOCS)
    ids = bpe.token_ids(docs).cache()
    places = packing.packed(ids, tokens=F.size("ids").cast("long"))
    rows = packing.sequences(places, ids).collect()
    assert all(len(r["ids"]) <= r["bin_capacity"] and len(r["starts"]) == len(r["doc_ids"]) and r["starts"][0] == 0 for r in rows)
    parts = {}
    for r in rows:
        for a, b, i in zip(r["starts"], [*r["starts"][1:], len(r["ids"])], r["doc_ids"], strict=True):
            parts[i] = parts.get(i, 0) + b - a
    assert parts == {r["doc_id"]: len(r["ids"]) for r in ids.collect() if r["ids"]}
    assert Counter(x for r in rows for x in r["ids"]) == Counter(x for r in ids.collect() for x in r["ids"])


def test_bpe_is_exact(spark, data, edges, nothing):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    ref = Tokenizer.from_file(path)
    ref.no_truncation()
    ref.no_padding()
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(edges.select("doc_id", "text"))
    texts = Counter()
    for r in docs.collect():
        ids = ref.encode(r["text"] or "", add_special_tokens=False).ids
        back = ref.decode(ids, skip_special_tokens=False)
        texts[(r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe.token_digests(docs, path).collect()) == texts
    assert bpe.token_digests(nothing, path).count() == 0


def test_media_round_trip(edges, nothing):
    for r in media.media_digests(edges).collect():
        texts = [t for i, t in EDGES if i == r["doc_id"]]
        raw = (texts[0] or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
    assert media.media_digests(nothing).count() == 0


def test_damaged_media_is_found():
    stored = media.mux(bytes(range(256)) * 400)
    assert media.joined(media.demux(stored)) == bytes(range(256)) * 400
    for at in (0, 30, len(stored) // 2, len(stored) - 1):
        bad = bytearray(stored)
        bad[at] ^= 1
        with pytest.raises(media.MediaError):
            media.demux(bytes(bad))
    with pytest.raises(media.MediaError):
        media.demux(stored[:-10])


def test_checksum_bit_by_bit():
    page = b"OggS" + bytes(range(90))
    register = 0
    for byte in page:
        register ^= byte << 24
        for _ in range(8):
            register = ((register << 1) ^ (0x04C11DB7 if register >> 31 else 0)) & 0xFFFFFFFF
    assert media.page_checksum(page) == register


def shingle_bag(text):
    """Five-word shingles as words, by a plainer path than the operator's."""
    words = "".join(c.lower() if c.isascii() else c for c in text).split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute_links(texts, threshold=0.8):
    """All pairs of distinct texts that are alike, from exact counts."""
    bags = {t: shingle_bag(t) for t in set(texts)}
    df = Counter(s for t in texts for s in bags[t])
    n = len(texts)
    idf = {s: 1 + min(1, math.log(n / c) / math.log(near_duplicates.SHARE)) if c * near_duplicates.SHARE >= n else 2 for s, c in df.items()}
    weights = {t: {s: (1 + math.log(f)) * idf[s] for s, f in bag.items()} for t, bag in bags.items()}
    by_shingle = {}
    for t, bag in bags.items():
        for x in bag:
            by_shingle.setdefault(x, []).append(t)
    links = set()
    for a, wa in weights.items():
        shared = Counter()
        for x, v in wa.items():
            for b in by_shingle[x]:
                if b > a:
                    shared[b] += min(v, weights[b][x])
        for b, low in shared.items():
            if low / (sum(wa.values()) + sum(weights[b].values()) - low) >= threshold:
                links.add((a, b))
    return links


def brute_classes(texts, threshold=0.8):
    """Classes by comparing all pairs."""
    root = {t: t for t in texts}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in brute_links(texts, threshold):
        root[top(a)] = top(b)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(top(t), i)
    return [first[top(t)] for t in texts]


def changed(text, seed, n):
    rng, words = np.random.default_rng(seed), text.split()
    for k in rng.integers(0, len(words), n):
        words[k] = f"new{seed}x{k}"
    return " ".join(words)


def test_near_duplicates_against_brute_force(spark):
    base, other = prose(11, 400), prose(12, 400)
    texts = [base, base, *(changed(base, s, 1 + s % 9) for s in range(40)), other, changed(other, 99, 2), *(prose(s, 150) for s in range(200, 220)), "", "", "one two"]
    rows = {r["doc_id"]: r for r in near_duplicates.classes(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert [rows[i]["class_id"] for i in range(len(texts))] == brute_classes(texts)
    assert rows[0]["class_size"] == sum(r["class_id"] == 0 for r in rows.values())


def test_near_duplicates_over_a_table(spark, data):
    rows = common.table(spark, data, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("doc_id").collect()
    found = {r["doc_id"]: r["class_id"] for r in near_duplicates.classes(common.table(spark, data, "documents")).collect()}
    ids, texts = [r["doc_id"] for r in rows], [r["text"] for r in rows]
    want = {ids[i]: ids[c] for i, c in enumerate(brute_classes(texts))}
    wanted = [i for i in ids if want[i] != i]
    assert sum(found[i] == want[i] for i in wanted) >= 0.9 * len(wanted)
    assert all(want[i] == want[c] for i, c in found.items())


@pytest.mark.parametrize("turn", range(3))
def test_links_that_a_leader_hides(spark, turn):
    """L leads r; t is like r and not like L, whichever of their keys is the least."""
    words = prose(31, 200).split()
    lead = " ".join(words)
    r = " ".join([*words[:-12], *(f"r{k}" for k in range(12))])
    t = " ".join([*words[:-12], *(f"r{k}" for k in range(12))][20:])
    near = [f"tail{turn}" if turn else "", lead, r, t]
    assert len(brute_links([lead, r, t])) == 2
    docs = spark.createDataFrame([(i, f"{x} x{turn}") for i, x in enumerate(near)], DOCS)
    assert [x["class_id"] for x in near_duplicates.classes(docs).orderBy("doc_id").collect()] == [0, 1, 1, 1]


def classes_of(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    roots = {bytes(r["key"]): bytes(r["root"]) for r in near_duplicates.rooted(docs, **options).collect()}
    keys = [hashlib.md5(t.encode()).digest() for t in texts]
    return [roots.get(k, k) for k in keys]


def test_hot_buckets_lose_no_class(spark):
    """With a small limit most buckets go through the join by rare shingles; the classes stay those of all pairs."""
    base = prose(11, 300)
    texts = [changed(base, s, 1 + s % 14) for s in range(160)]
    found, want = classes_of(spark, texts, small=8, slack=None), brute_classes(texts)
    assert len({(a, b) for a, b in zip(found, want, strict=True)}) == len(set(found)) == len(set(want))


@pytest.mark.parametrize("shared, threshold, slack", [(10, 0.8, near_duplicates.SLACK), (7, 0.79, None)])
def test_pages_of_one_template_keep_their_pairs(spark, shared, threshold, slack):
    """400 pairs among 800 pages that all have most of their words in common, pairs just over the threshold, others just under it."""
    rng = np.random.default_rng(shared)
    common_part = prose(21, 600)

    def words(n, name):
        return " ".join(f"{name}{k}" for k in rng.integers(0, 10**9, n))

    texts = []
    for k in range(400):
        both = words(shared, "p")
        texts += [f"{common_part} {both} {words(42 - shared, 'x')}", f"{common_part} {both} {words(42 - shared, 'y')}"]
    found = classes_of(spark, texts, threshold=threshold, slack=slack)
    pairs = sum(found[i] == found[i + 1] for i in range(0, 800, 2))
    assert pairs >= 398 and len(set(found)) == 800 - pairs


def test_without_duplicates_keeps_clashing_columns(spark):
    rows = [(1, prose(1), "a", 5, "z"), (2, prose(1), "b", 6, "y"), (None, prose(1), "c", 7, "x"), (3, prose(2), "d", 8, "w")]
    docs = spark.createDataFrame(rows, f"{DOCS}, key string, place int, root string")
    assert sorted(tuple(r) for r in near_duplicates.without_duplicates(docs).collect()) == [rows[0], rows[3]]


def test_near_duplicates_edges(edges, nothing):
    out = near_duplicates.without_duplicates(edges)
    assert out.columns == edges.columns
    assert sorted(((r["doc_id"] or -1) for r in out.collect())) == [-1, 1, 3, 4, 5, 7, 8]
    assert near_duplicates.classes(nothing).count() == 0 == near_duplicates.without_duplicates(nothing).count()


def test_quality_rules_edges(edges, nothing):
    rows = {r["doc_id"]: r for r in quality_rules.rule_report(edges).collect()}
    assert rows[1]["n_words"] == rows[3]["n_words"] == 0 and rows[1]["base_failed"] and rows[7]["n_words"] == 30_000
    assert rows[5]["kept"] and rows[8]["word_chars"] == 6
    assert quality_rules.rule_report(nothing).count() == 0
    passed = quality_rules.passing(edges)
    assert passed.columns == edges.columns and {r["doc_id"] for r in passed.collect()} == {r["doc_id"] for r in rows.values() if r["kept"]}
    names = sorted(quality_rules.text_rules(F.col("text")))
    for order in (names, names[::-1]):
        assert quality_rules.passing(edges, order=order).count() == passed.count()


def test_repeated_words(spark):
    text = "a b c x a b c y z z z z"
    assert spark.createDataFrame([(1, text)], DOCS).select(quality_rules.measures(F.col("text"))["by_word"]["n_repeat_words"]).first()[0] == 10


@pytest.mark.parametrize(("operator", "label"), [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_learned_scores(spark, operator, label):
    rows, labels = [], []
    for i in range(240):
        bad = i % 2
        words = prose(i, 60).split()
        if bad:
            words[10:14] = ["vile", "filth", "vile", "filth"] if label == "toxic" else ["###", "$$$", "###", "1234"]
            if label == "quality":
                words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, 1 - bad if label == "quality" else bad))
    docs, known = spark.createDataFrame([*rows, (9_000, None), (9_001, "")], DOCS), spark.createDataFrame(labels, f"doc_id long, {label} int")
    model = operator.fit(docs, known)
    out = {r["doc_id"]: r for r in operator.scored(docs, model).collect()}
    truth = dict(labels)
    held = [i for i in truth if out[i]["held_out"]]
    assert len(held) > 20 and np.mean([out[i]["predicted"] == truth[i] for i in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[9_000]["score"] == out[9_001]["score"]
    again = operator.fit(docs, known.union(spark.createDataFrame([(None, 1), (None, 0), (3, None)], f"doc_id long, {label} int")))
    assert {r["doc_id"]: r["predicted"] for r in operator.scored(docs, again).collect()} == {i: r["predicted"] for i, r in out.items()}
    none = operator.fit(docs, known.limit(0))
    assert operator.scored(docs, none).count() == len(out)
    assert operator.scored(docs.limit(0), model).count() == 0


def plain_mix(bits, tables, start):
    """One lane's log probability, bit by bit."""
    limit, out = lm_scoring.LIMIT, []
    squash = lambda x: 1 / (1 + math.exp(-x))
    clip = lambda x, m: max(-m, min(m, x))
    for lane in range(len(bits.lane_text)):
        weights, refine, memory, total = start.weights.astype(float).copy(), start.refine.astype(float).copy(), Counter(), 0.0
        for i in np.flatnonzero(bits.lane == lane):
            known = memory[bits.local[i]]
            x = np.array([*(tables[k][bits.places[k][i]] / lm_scoring.GRADES for k in range(lm_scoring.PREDICTORS)), known])
            w = weights[:, bits.gate[i]]
            z = clip(float(w @ x), limit)
            cell = lm_scoring.REFINE // 2 + int(z * (lm_scoring.REFINE - 1) / (2 * limit))
            r, bit = refine[cell], int(bits.bit[i])
            p = squash(0.75 * z + 0.25 * r)
            assert 0 < p < 1
            total += math.log(p if bit else 1 - p)
            weights[:, bits.gate[i]] = w + lm_scoring.RATE * (bit - squash(z)) * x
            memory[bits.local[i]] = clip(known + 1.2 * (bit - squash(known)), 6)
            refine[cell] = clip(r + 0.3 * (bit - squash(r)), limit)
        out.append(total)
    return out


def test_lm_mixing_bit_by_bit(spark):
    docs = spark.createDataFrame([(i, prose(i, 80)) for i in range(60)], DOCS)
    model, _ = lm_scoring.fit(docs)
    texts = [prose(500, 700).encode(), b"", b"Never seen w1 w2", "é 漢字 w3".encode()]
    w = lm_scoring.Words.of(texts, model.book)
    unknown = w.ids[w.at] == model.book.escape
    bits = lm_scoring.bits_of(w, len(texts), model.book, unknown)
    assert unknown.sum() == 4 and len(bits.lane_text) > len(texts)
    found, _ = lm_scoring.mixed_bits(bits, model.tables, model.start)
    assert found == pytest.approx(plain_mix(bits, model.tables, model.start), rel=1e-4)
    # What is below the mixed bits adds up to one for each top.
    assert np.bincount(model.book.leaf, weights=np.exp(model.book.below)) == pytest.approx(1)


def small_book(n):
    words = [lm_scoring.END, *(f"w{i}" for i in range(n))]
    return lm_scoring.Codebook(words, np.arange(n + 2, 0, -1), 1, 1)


def test_lm_lookup_and_words_as_arrays():
    book = small_book(30_000)
    text = "W5 never w29999  é漢字 w30000 w0 w5".split(" ")
    tokens = lm_scoring.Tokens.of([" ".join(text).encode(), b"", b"w7"])
    plain = [x.lower() for x in text if x] + ["w7"]
    assert tokens.words(np.arange(len(plain))).to_pylist() == plain
    assert tokens.words(np.array([4, 0, 4])).to_pylist() == ["w30000", "w5", "w30000"] and len(tokens.words(np.zeros(0, np.int64))) == 0
    assert [book.words[i] if i < book.escape else None for i in book.lookup(tokens.hashes)] == [x if x in set(book.words) else None for x in plain]
    assert (book.lookup(lm_scoring.word_hash(book.words[1:])) == np.arange(1, 30_001)).all()  # some share their first bits
    assert (book.lookup(np.array([0, 2**64 - 1], np.uint64)) == book.escape).all()


def test_lm_mixing_holds_no_more_than_the_bits():
    book = small_book(1_000)
    texts = [b"w7"] * 20_000 + [b"w3 w900 " * 400]
    w = lm_scoring.Words.of(texts, book)
    bits = lm_scoring.bits_of(w, len(texts), book, np.zeros(len(w.at), bool))
    tables = [np.zeros((rows + 1) * lm_scoring.NODES, np.int8) for rows in lm_scoring.WORD_ROWS]
    tracemalloc.start()
    found, _ = lm_scoring.mixed_bits(bits, tables, lm_scoring.Start())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(found[:20_000].tolist())) == 1 and found[-1] < found[0] < 0
    # A lane keeps what it learns, 1.5 KB, not a place for each bit of the longest lane.
    assert peak < 4_000 * len(bits.lane_text) + 64 * len(bits.bit)


def test_lm_gains_with_the_corpus(spark, data):
    docs = common.table(spark, data, "documents")
    model, counts = lm_scoring.fit(docs)
    rows = lm_scoring.scored(docs, model, counts).where("n_tokens = n_known AND n_tokens > 1").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows["s"] > rows["b"]


def test_lm_base_score_and_probabilities(spark, edges, nothing):
    docs = spark.createDataFrame([*((i, prose(i, 80)) for i in range(60)), (100, None), (101, "Never Seen never")], DOCS)
    model, counts = lm_scoring.fit(docs)
    out = {r["doc_id"]: r for r in lm_scoring.scored(docs, model, counts).collect()}
    tokens = {r["doc_id"]: [*(r["text"] or "").lower().split(), "\n"] for r in docs.collect()}
    c = Counter(t for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for t in ts)
    n, v = sum(c.values()), len(c)
    for i, ts in tokens.items():
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(c[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts))
        assert r["score"] < 0 and r["total_bits"] == pytest.approx(-r["score"] * math.log2(10))
    assert lm_scoring.scored(edges, model, counts).count() == len(EDGES)
    none, no_counts = lm_scoring.fit(nothing)
    assert lm_scoring.scored(docs, none, no_counts).where("n_known = 0 AND base_score = 0").count() == docs.count()


def test_url_filters(spark):
    day = "cast('2024-0%d-01' AS date)"
    events = spark.sql(f"SELECT * FROM VALUES ('bad.org', {day % 2}, 0, true), ('bad.org', {day % 4}, 1, false), ('a.b.com/x', {day % 1}, 0, true), (null, {day % 1}, 0, true) AS t(key, day, seq, listed)")
    captures = spark.sql(f"SELECT * FROM VALUES (1, 'http://www.bad.org/p', {day % 3}), (2, 'http://www.bad.org/p', {day % 4}), (3, 'https://a.b.com/x/y', {day % 2}), (4, null, {day % 2}), (5, 'http://notbad.org', {day % 3}), (6, 'http://bad.org', cast(null AS date)) AS t(capture_id, url, day)")
    assert {r["capture_id"]: r["blocked"] for r in url_filters.evaluate(captures, events).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False}
    assert url_filters.evaluate(captures, events.limit(0)).where("blocked").count() == 0


def test_neighbours_vote_by_brute_force():
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    known, asked, labels = unit(rng.normal(size=(500, 16))), unit(rng.normal(size=(300, 16))), rng.integers(0, 2, 500)
    space = quality_classifier.LatentSpace(np.ones(1), np.ones((1, 1)), known, labels)
    want = []
    for x in asked:
        sims = [float(x @ v) for v in known]
        near = sorted(range(500), key=lambda i: -sims[i])[: quality_classifier.NEIGHBOURS]
        weight = [max(sims[i], 1e-6) ** 4 for i in near]
        want.append(sum(w * labels[i] for w, i in zip(weight, near, strict=True)) / sum(weight))
    assert space.vote(asked) == pytest.approx(want)


def test_short_circuit_order_is_by_rejection_per_cost(spark, data):
    docs = common.table(spark, data, "documents")
    order = quality_rules.cascade_order(docs)
    assert sorted(order) == sorted(quality_rules.text_rules(F.col("text")))


def test_license_inheritance(spark):
    mit = "Released under the MIT License."
    files = spark.createDataFrame([(1, "r/LICENSE", mit), (2, "r/a/b/c.txt", "text"), (3, "q/x.txt", None), (4, None, mit), (5, "r/a/LICENSE", "Licensed under the Apache License, Version 2.0."), (6, "r/z.txt", "")], "file_id long, path string, text string")
    out = {r["file_id"]: (r["license"], r["inherited_from"]) for r in license_scan.scan(files).collect()}
    assert license_scan.scan(files.limit(0)).count() == 0
    assert out == {1: ("MIT", None), 2: ("Apache-2.0", "r/a"), 3: (None, None), 4: ("MIT", None), 5: ("Apache-2.0", None), 6: ("MIT", "r")}


MIT_FILE = """MIT License

Copyright (c) 2021 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
def f(): pass
x = 1
"""


def test_whole_licences_headers_and_tags(spark):
    rows = [(1, "a/LICENSE", MIT_FILE), (2, "a/x.py", "x = 1"), (3, "b/y.py", GPL_HEADER), (4, "c/z.py", "# SPDX-License-Identifier: Apache-2.0"), (5, "d/w.py", "# SPDX-License-Identifier: GPL-3.0-only\ny = 2\nz = 3"), (6, "e/v.py", "the licence of the poet was large and wide")]
    out = {r["file_id"]: r["license"] for r in license_scan.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert out == {1: "MIT", 2: "MIT", 3: "GPL-3.0", 4: "Apache-2.0", 5: "GPL-3.0", 6: None}


def test_pipeline_against_plain_stages(spark, data):
    docs = common.table(spark, data, "documents")
    space = quality_classifier.fit(docs, common.table(spark, data, "labels"))
    rows = docs.collect()
    score = dict(zip([r["doc_id"] for r in rows], space.score([r["text"] or "" for r in rows]), strict=True))
    good = {r["doc_id"] for r in rows if score[r["doc_id"]] >= 0.5}
    kept = {r["doc_id"] for r in quality_rules.rule_report(docs).where("kept").collect()} & good
    rest = sorted((r["doc_id"], r["text"] or "") for r in rows if r["doc_id"] in kept)
    first = {rest[c][0] for c in brute_classes([t for _, t in rest])}
    words = {i: len([w for w in re.split("[ \t-\r]+", t) if w]) for i, t in rest if i in first}
    found = Counter()
    for r in corpus_pipeline.run(spark, data).collect():
        found[r["doc_id"]] += r["n_tokens"]
    assert found == words


def test_pipeline(spark, data):
    docs = common.table(spark, data, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out
    assert corpus_pipeline.run(spark, data).count() > 0
