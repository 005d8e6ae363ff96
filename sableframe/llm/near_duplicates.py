"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Shingles that are in at least one text of `1 / SHARE` have their number of
   texts counted exactly: a table of sums by hashed slot, which can only be too
   high, picks the slots that may hold one; a second pass counts the shingles of
   those slots. At most SHARE times the mean number of shingles of a text can
   qualify, so their table has a bound that doesn't grow with the corpus.
2. A shingle weighs (1 + ln tf) * idf, with idf from 1 (in every text) to 2 (in
   a share of 1 / SHARE or less). Consistent weighted samples of two texts agree
   as often as their weighted Jaccard similarity says; samples go into bands,
   bands into buckets. Two bits of each of some more samples make a sketch.
3. In each bucket the most central text (that in the largest buckets over all
   bands) leads, and all others are compared with it. Links make classes by
   alternating star contractions.
4. Buckets of at most `SMALL` texts then compare what is still in different
   classes. The texts of larger ones with several classes (pages of one template,
   say) are compared by what they don't share with the others: their shingles,
   ordered by the number of these texts that have them, rarest first, up to more
   than 1 - threshold of their weight. Two texts as alike as the threshold share
   one of these, whatever else they have (the prefix filter of set joins), so
   none is lost; what is common to all of them is in no such prefix unless a text
   is little else, and then its leader has linked it. Those that share such a
   shingle meet a leader first, too.
5. Only pairs whose sketches agree as often as the threshold says, less
   `SLACK` standard deviations, read their texts for the exact similarity
   (`slack=None` leaves this test out, so every pair of 4 is compared exactly).
   Equal texts are one node throughout, so copies cost nothing; a class's id is
   its least doc_id.

Null texts count as empty. Texts without words are alike only if equal. Texts
of one to four words are one shingle. Repeated rows fall into one class, rows
with null ids too; an empty table gives no rows. Ties between leaders are broken
by the text's key. Other columns, of any name, are ignored by `classes` and kept
by `without_duplicates`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table, text_blocks, tree_sum
from .shingles import mixed, shingle_sets

THRESHOLD = 0.8
BANDS, ROWS = 24, 6
#: Shingles in fewer texts than one of so many have the highest weight.
SHARE = 256
#: Slots of the table that finds such shingles, the slices in which it is added up, and rows of random parameters.
SLOTS, SLICES = 1 << 18, 16
PARAMETERS = 1 << 13
CHUNK = 1024
#: Samples of a sketch, and its long columns: two bits for each sample, 32 to a column.
SKETCH_SAMPLES = 576
SKETCH = [f"s{i}" for i in range(SKETCH_SAMPLES // 32)]
SLACK = 4.0
#: Texts of a bucket whose classes are all compared with each other.
SMALL = 32
#: Rows of a partition of what is left to compare.
PARTITION_ROWS = 20_000
#: What rounding may take from a similarity, and rounds in which texts with a rare shingle in common meet one leader before all of them meet.
ROUNDING, STARS = 1e-6, 2


def text_key(text: Column) -> Column:
    """One value for equal texts."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


# -- document frequencies ---------------------------------------------------


@dataclass
class Idf:
    """Sorted hashes of frequent shingles and their weights; any other shingle weighs 2."""

    hashes: np.ndarray
    weights: np.ndarray

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), 2.0)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.weights[at], 2.0)


def slot_of(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(SLOTS)).astype(np.int64)


def encoded(block: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in block.column("text").to_pylist()]


def slot_sums(docs: DataFrame) -> np.ndarray:
    """Texts by the slots of their shingles, added up over all tasks."""
    per = SLOTS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, any_ = np.zeros(SLOTS, np.int64), False
        for block in text_blocks(batches, limit=1_000_000):
            sums += np.bincount(slot_of(shingle_sets(encoded(block))[0]), minlength=SLOTS)
            any_ = True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([sums[i * per : (i + 1) * per].tobytes() for i in range(SLICES)], pa.binary())], names=["k", "v"])

    out = np.zeros(SLOTS, np.int64)
    for r in tree_sum(docs.select("text").mapInArrow(count, "k int, v binary")).collect():
        out[r["k"] * per : (r["k"] + 1) * per] = np.frombuffer(r["v"], np.int64)
    return out


def frequent_shingles(docs: DataFrame) -> Idf:
    """Exact weights of all shingles that are in at least one text of SHARE."""
    n = docs.count()
    least = max(1, -(-n // SHARE))
    maybe = docs.sparkSession.sparkContext.broadcast(slot_sums(docs) >= least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0

        def out() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(some), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "df"])

        for block in text_blocks(batches, limit=1_000_000):
            h = shingle_sets(encoded(block))[0]
            some.append(h[maybe.value[slot_of(h)]])
            size += len(some[-1])
            if size > 2_000_000:
                yield out()
                some, size = [], 0
        if size:
            yield out()

    counts = docs.select("text").mapInArrow(count, "h long, df long").groupBy("h").agg(F.sum("df").alias("df"))
    rows = counts.where(F.col("df") >= least).toPandas()
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    weights = 1 + np.minimum(1, np.log(n / rows["df"].to_numpy(np.float64)) / math.log(SHARE))
    return Idf(h[order], weights[order])


# -- weighted samples -------------------------------------------------------


@dataclass
class Sampler:
    """Gamma and uniform parameters by hashed shingle and sample."""

    samples: int = BANDS * ROWS
    rows: int = PARAMETERS
    seed: int = 7

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        shape = (self.rows, self.samples)
        self.r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
        self.beta = rng.random(shape).astype(np.float32)

    def signatures(self, h: np.ndarray, log_w: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Least log a = log c - r (t - beta + 1), t = floor(log w / r + beta), for each text and sample.

        The value stands for the pair (shingle, t) that has it: shingles of one
        row of parameters differ by a shift of beta that is their own.
        """
        out = np.full((len(counts), self.samples), np.inf, np.float32)
        owner = np.repeat(np.arange(len(counts)), counts)
        row = (h % np.uint64(self.rows)).astype(np.int64)
        shift = ((h >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24))[:, None]
        log_w = log_w.astype(np.float32)[:, None]
        x, beta, r = (np.empty((CHUNK, self.samples), np.float32) for _ in range(3))
        for a in range(0, len(h), CHUNK):
            b = min(a + CHUNK, len(h))
            rows, xs, bs, rs = row[a:b], x[: b - a], beta[: b - a], r[: b - a]
            np.take(self.beta, rows, axis=0, out=bs, mode="clip")
            np.take(self.inverse, rows, axis=0, out=xs, mode="clip")
            np.take(self.r, rows, axis=0, out=rs, mode="clip")
            bs += shift[a:b]
            xs *= log_w[a:b]
            xs += bs
            np.floor(xs, out=xs)
            xs -= bs
            xs += 1
            xs *= rs
            np.take(self.log_c, rows, axis=0, out=bs, mode="clip")
            bs -= xs
            own = owner[a:b]
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            least = np.minimum.reduceat(bs, starts, axis=0)
            out[own[starts]] = np.minimum(out[own[starts]], least)
        return out

    def bands(self, signatures: np.ndarray) -> np.ndarray:
        """One 64-bit bucket for each text and band."""
        bits = signatures.view(np.uint32).astype(np.uint64).reshape(len(signatures), BANDS, -1)
        key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
        for k in range(bits.shape[2]):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, k])
        return key.view(np.int64)


def weighted(texts: list[bytes], idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, their weights, and how many each text has."""
    h, tf, counts = shingle_sets(texts)
    return h, (1 + np.log(tf)) * idf(h), counts


def sketched(texts: DataFrame, idf) -> DataFrame:
    """(key, s0, s1, ...): the sketch of each text of (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(SKETCH_SAMPLES, PARAMETERS // 4, seed=8)
        for block in text_blocks(batches, limit=1_000_000):
            h, w, counts = weighted(encoded(block), idf.value)
            bits = mixed(sampler.signatures(h, np.log(w), counts).view(np.uint32).astype(np.uint64)) & np.uint64(3)
            longs = (bits.reshape(len(counts), len(SKETCH), 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([block.column("key"), *(pa.array(longs[:, i].view(np.int64)) for i in range(len(SKETCH)))], names=["key", *SKETCH])

    return texts.mapInArrow(run, ", ".join(["key binary", *(f"{c} long" for c in SKETCH)]))


def plausible(other: str, threshold: float, slack: float | None) -> Column:
    """Whether the sketch agrees with that in the columns named `other` + its own names."""
    if slack is None:
        return F.lit(True)
    low = F.lit(0x5555555555555555)
    different = F.lit(0)
    for c in SKETCH:
        x = F.col(c).bitwiseXOR(F.col(other + c))
        different = different + F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(low))
    same = threshold + (1 - threshold) / 4
    return different <= int(SKETCH_SAMPLES * (1 - same + slack * (same * (1 - same) / SKETCH_SAMPLES) ** 0.5))


def buckets(keyed: DataFrame, idf) -> DataFrame:
    """(bucket, key): each distinct text once in each of its buckets. `idf` is a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, seen = Sampler(), set()
        for block in text_blocks(batches, limit=1_000_000):
            keys, texts = block.column("key").to_pylist(), block.column("text").to_pylist()
            todo = {k: (t or "").encode() for k, t in zip(keys, texts, strict=True) if k not in seen}
            if len(seen) > 50_000:  # copies in one task are skipped, those of others meet below
                seen.clear()
            seen.update(todo)
            h, w, counts = weighted(list(todo.values()), idf.value)
            has = counts > 0
            own = [k for k, ok in zip(todo, has.tolist(), strict=True) if ok]
            if own:
                found = sampler.bands(sampler.signatures(h, np.log(w), counts[has]))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array([k for k in own for _ in range(BANDS)], pa.binary())], names=["bucket", "key"])

    return keyed.mapInArrow(run, "bucket long, key binary").distinct()


def prefixes(texts: DataFrame, idf, threshold: float) -> DataFrame:
    """(h, key, total, rest): of each text the rarest shingles that hold more than 1 - threshold of its whole weight.

    Rarity is that among these texts, by slots, then the hash: any order serves
    that is the same for all of them. `rest` is the weight of a shingle and all
    after it.
    """
    counts = texts.sparkSession.sparkContext.broadcast(slot_sums(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=1_000_000):
            h, w, sizes = weighted(encoded(block), idf.value)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((h, counts.value[slot_of(h)], owner))
            h, w = h[order], w[order]
            total = np.bincount(owner, w, len(sizes))
            before = np.cumsum(w) - w
            first = np.repeat(before[np.minimum(np.cumsum(sizes) - sizes, max(len(w) - 1, 0))], sizes) if len(w) else before
            kept = before - first <= (1 - threshold + ROUNDING) * total[owner]
            keys = block.column("key").take(pa.array(owner[kept]))
            rest = (total[owner] - (before - first))[kept]
            yield pa.RecordBatch.from_arrays([pa.array(h[kept].view(np.int64)), keys, pa.array(total[owner[kept]]), pa.array(rest)], names=["h", "key", "total", "rest"])

    return texts.select("key", "text").mapInArrow(run, "h long, key binary, total double, rest double")


# -- links ------------------------------------------------------------------


def similarities(pairs: DataFrame, idf) -> DataFrame:
    """(a, b, similarity) of rows (a, text_a, b, text_b): exact weighted Jaccard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            out = []
            for a, ta, tb in zip(batch.column("a"), batch.column("text_a"), batch.column("text_b"), strict=True):
                if a.as_py() != last[0]:
                    last = (a.as_py(), weighted([(ta.as_py() or "").encode()], idf.value))
                ha, wa, _ = last[1]
                hb, wb, _ = weighted([(tb.as_py() or "").encode()], idf.value)
                _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
                low, high = np.minimum(wa[i], wb[j]).sum(), np.maximum(wa[i], wb[j]).sum()
                union = wa.sum() + wb.sum() - wa[i].sum() - wb[j].sum() + high
                out.append(float(low / union) if union else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    # Rounded, so that the order of sums doesn't decide at the threshold.
    found = pairs.select("a", "text_a", "b", "text_b").mapInArrow(run, "a binary, b binary, similarity double")
    return found.select("a", "b", F.round("similarity", 9).alias("similarity"))


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """With both texts; the greater key comes last, so that the pairs of one leader end in many tasks."""
    a = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(a, "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")


def prefixed(df: DataFrame, *names: str) -> DataFrame:
    """The named columns with `a_` before their names."""
    return df.select(*(F.col(c).alias(f"a_{c}") for c in names))


def gathered(df: DataFrame) -> DataFrame:
    """A checkpoint of the rows in no more partitions than their number asks for: what is left to compare is soon small."""
    rows = checkpointed(df)
    return rows.coalesce(max(2, -(-rows.count() // PARTITION_ROWS)))


def same_buckets(keyed: DataFrame, idf) -> tuple[DataFrame, DataFrame]:
    """(bucket, key) of texts that share a bucket, and (key, text, sketch) of those texts."""
    members = buckets(keyed, idf)
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    members = gathered(members.join(shared, "bucket"))
    # One row for each text, found by its least id, so that rows with texts don't meet by key alone.
    places = keyed.groupBy("key").agg(F.min("place").alias("place")).join(members.select("key").distinct(), "key", "left_semi")
    texts = checkpointed(keyed.join(places, ["key", "place"], "left_semi").dropDuplicates(["key", "place"]).select("key", "text"))
    return members, texts


def led(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`placed` (bucket, key, root) with the sizes of buckets of two texts or more, and the leader of each."""
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    sized = placed.join(sizes, "bucket")
    central = sized.groupBy("key").agg(F.sum("size").alias("central"))
    sized = gathered(sized.join(central, "key"))
    names = ["key", "root"]
    first = sized.groupBy("bucket").agg(F.max(F.struct("central", *names)).alias("first"))
    return sized.drop("central"), first.select("bucket", *(F.col(f"first.{c}").alias(f"a_{c}") for c in names))


def in_classes(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """With the column `root`: the class so far, or the text itself."""
    if roots is None:
        return members.withColumn("root", F.col("key"))
    return members.drop("root").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))


def of_several_classes(placed: DataFrame) -> DataFrame:
    """Rows of the buckets that still have texts of different classes."""
    several = placed.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("bucket")
    return placed.join(several, "bucket", "left_semi")


def rooted(docs: DataFrame, threshold: float = THRESHOLD, slack: float | None = SLACK, small: int = SMALL) -> DataFrame:
    """The roots of texts that are like another one: (key, root)."""
    idf = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs))
    keyed = docs.select(text_key(F.col("text")).alias("key"), "text", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("place"))
    members, texts = same_buckets(keyed, idf)
    sketches = gathered(sketched(texts, idf))
    roots: DataFrame | None = None
    done: list[DataFrame] = []

    def verify(pairs: DataFrame) -> None:
        """Compare the pairs (a_key, key) that weren't compared before; their links join classes."""
        nonlocal roots
        ordered = F.col("key") < F.col("a_key")
        sides = [F.when(ordered, F.col(x)).otherwise(F.col(y)) for x, y in (("key", "a_key"), ("a_key", "key"), ("root", "a_root"), ("a_root", "root"))]
        named = pairs.select(*(c.alias(n) for c, n in zip(sides, ("a", "b", "root_a", "root_b"), strict=True)))
        pairs = named.groupBy("a", "b").agg(F.min("root_a").alias("root_a"), F.min("root_b").alias("root_b"))
        for before in done:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = gathered(pairs)
        if roots is not None and pairs.isEmpty():
            return
        done.append(pairs.select("a", "b"))
        like = similarities(with_texts(pairs.select("a", "b"), texts), idf).where(F.col("similarity") >= threshold).select("a", "b")
        # Only classes are linked from here on, so that later rounds don't go over earlier links again.
        now = gathered(pairs.join(like, ["a", "b"], "left_semi").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
        if roots is None:
            roots = components(now)
        elif not now.isEmpty():
            merged = components(now)
            moved = roots.join(merged.select(F.col("key").alias("root"), F.col("root").alias("to")), "root", "left").select("key", F.coalesce("to", "root").alias("root"))
            roots = gathered(moved.union(merged))

    placed, leaders = led(of_several_classes(in_classes(members, roots)))
    led_pairs = placed.join(leaders, "bucket").where("root != a_root").select("key", "a_key", "root", "a_root").distinct()
    verify(led_pairs.join(sketches, "key").join(prefixed(sketches, "key", *SKETCH), "a_key").where(plausible("a_", threshold, slack)))
    left = gathered(of_several_classes(in_classes(placed, roots)))
    few = left.where(F.col("size") <= small).select("bucket", "key", "root").join(sketches, "key")
    pairs = few.join(prefixed(few, "bucket", "key", "root", *SKETCH).withColumnRenamed("a_bucket", "bucket"), "bucket")
    verify(pairs.where((F.col("key") < F.col("a_key")) & (F.col("root") != F.col("a_root")) & plausible("a_", threshold, slack)))
    many = of_several_classes(in_classes(left.where(F.col("size") > small), roots))
    active = gathered(many.select("key", "root").distinct())
    if active.isEmpty():
        return roots
    rare = gathered(prefixes(texts.join(active, "key", "left_semi"), idf, threshold).withColumnRenamed("h", "bucket"))
    for _ in range(STARS):
        placed, leaders = led(of_several_classes(in_classes(rare.select("bucket", "key"), roots)))
        near = placed.join(leaders, "bucket").where("root != a_root").select("key", "a_key", "root", "a_root").distinct()
        verify(near.join(sketches, "key").join(prefixed(sketches, "key", *SKETCH), "a_key").where(plausible("a_", threshold, slack)))
    rare = gathered(of_several_classes(in_classes(rare, roots))).join(sketches, "key")
    pairs = rare.join(prefixed(rare, "bucket", "key", "root", "total", "rest", *SKETCH).withColumnRenamed("a_bucket", "bucket"), "bucket")
    # At the first shingle that both have, what is left of each must hold all that they share.
    least = (threshold - ROUNDING) / (1 + threshold)
    alike = (F.least("total", "a_total") >= (threshold - ROUNDING) * F.greatest("total", "a_total")) & (F.least("rest", "a_rest") >= least * (F.col("total") + F.col("a_total")))
    verify(pairs.where((F.col("key") < F.col("a_key")) & (F.col("root") != F.col("a_root")) & alike & plausible("a_", threshold, slack)))
    return roots


# -- classes ----------------------------------------------------------------


def components(pairs: DataFrame) -> DataFrame:
    """(key, root): connected components; the root is the least key."""
    def both_ways(first: Column, second: Column) -> Column:
        return F.inline(F.array(first, second))

    def edge(u: str, v: str) -> Column:
        return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))

    edges = gathered(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        # Two rows out of each instead of unions, which would double the tasks and files of every shuffle.
        both = edges.select(both_ways(edge("u", "v"), edge("v", "u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = checkpointed(large.join(least, "u").select(both_ways(edge("u", "m"), edge("v", "m"))).where("u != v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = edges.coalesce(max(2, -(-now[0] // PARTITION_ROWS)))
        if now == before:
            return edges.select(F.col("u").alias("key"), F.col("v").alias("root"))
        before = now


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least id of the class) and class_size for each row of `docs` (doc_id, text)."""
    roots = rooted(docs, threshold)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"))
    rows = rows.join(roots, "key", "left").select("doc_id", F.coalesce("root", "key").alias("root"))
    sums = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(sums, "root").select("doc_id", "class_id", "class_size")


def without_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row of the least doc_id of each class, all columns as they are.

    Ids go before nulls. Rows that repeat both the id and the text are one row
    here, whatever their other columns hold.
    """
    roots = rooted(docs, threshold)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    place = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    packed = docs.select(row, F.col("doc_id").alias("id"), place.alias("place"), text_key(F.col("text")).alias("key"))
    rows = packed.select("id", "place", "key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    keep = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place", "key")).alias("first")).select("first.place", "first.key")
    return packed.join(keep, ["place", "key"], "left_semi").dropDuplicates(["place", "key"]).select("row.*")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
