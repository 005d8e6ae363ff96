"""Collocations: phrases that occur more often than their parts suggest.

Texts become arrays of word numbers, a block and language a row. Level by level,
a phrase of m words is a candidate if both its parts of m - 1 words are frequent
(the Apriori rule loses none). The distinct candidates of a block, counted, are
dealt into shards by their key, once. A shard's keys get a minimal perfect hash
that stores them; its blocks' counts are added into arrays by slot, some blocks
an array, and the arrays summed in a tree. A key is the number of the first
m - 1 words and the last word's in 64 bits, so it is exact; frequent slots are
numbered for the next level. Shards follow the number of words, so neither a
hash nor a group grows with the corpus. Only a vocabulary of at most
`BROADCAST_WORDS` is broadcast. Parts of a cut are read by slot from the level's
shards.

Null texts count as empty, a null language as `und`. Repeated rows count each
time. Ties of scores go by the count, then by the phrase. Long texts are blocks
of their own. An empty table gives no rows; extra columns are ignored. The keys
have 63 bits for both numbers together; more frequent phrases are an error.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sableframe.operators.running import ranked

from .common import checkpoint_folder, removed, table, text_blocks
from .perfect_hash import PerfectHash, spread

#: Words of a phrase at most, its least count, the share of a longer phrase that replaces it (percent), rows of a language, and the scale of scores.
LONGEST, LEAST, COVERED, TOP, SCALE = 3, 10, 50, 2000, 1_000_000
#: Bytes of text in a block, words for each shard, blocks counted into one array, and the largest vocabulary that is broadcast.
BLOCK, SHARD_WORDS, ARRAY_BLOCKS, BROADCAST_WORDS = 4_000_000, 2_000_000, 64, 500_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BREAK, BLANK = np.zeros(256, bool), np.zeros(256, bool)
BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
BLANK[list(b" \t")] = True


def packed(x: np.ndarray) -> bytes:
    """Whole numbers compressed: how many, then their first bytes, their second ones and so on."""
    if not len(x):
        return bytes(8)
    return len(x).to_bytes(8, "little") + pa.compress(x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    raw = pa.decompress(x[8:], 8 * n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel().astype(np.int64)


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words in order, -1 where a piece ends, and the words by code."""
    joined = b"\n".join([b"", *texts, b""]).translate(LOWER)
    raw = np.frombuffer(joined, np.uint8)
    breaks = BREAK[raw]
    gap = breaks | BLANK[raw]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    if not len(starts):
        return np.zeros(0, np.int32), pa.array([], pa.string())
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    letters = pa.py_buffer(np.ascontiguousarray(raw[~gap]))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), letters).dictionary_encode()
    apart = np.diff(np.cumsum(breaks, dtype=np.int32)[starts]) > 0
    at = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(apart)])
    codes = np.full(int(at[-1]) + 1, -1, np.int32)
    codes[at] = words.indices.to_numpy()
    return codes, words.dictionary.cast(pa.string())


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches, limit=BLOCK):
        texts = defaultdict(list)
        for lang, text in zip(block["lang"].to_pylist(), block["text"].cast(pa.binary()).to_pylist(), strict=True):
            texts[lang].append(text or b"")
        for lang, own in texts.items():
            codes, words = word_codes(own)
            if len(codes):
                counts = np.bincount(codes[codes >= 0], minlength=len(words)).astype(np.int64)
                ends = pa.array([0, len(words)], pa.int32())
                row = {"lang": [lang], "codes": pa.array([packed(codes)], pa.binary()), "words": pa.ListArray.from_arrays(ends, words), "counts": pa.ListArray.from_arrays(ends, counts)}
                yield pa.RecordBatch.from_pydict(row)


class Phrases:
    """Counts of all phrases of up to `longest` words that occur `least` times or more, by language.

    `vocabulary` has lang, word, number and f of the frequent words, `totals` the
    words of each language, `found` a table for each level from 2 on with the
    words' numbers and f.
    """

    def __init__(self, docs: DataFrame, longest: int = LONGEST, least: int = LEAST, shard_words: int = SHARD_WORDS):
        self.spark, self.longest, self.least = docs.sparkSession, longest, least
        self.folder, self.kept = f"{checkpoint_folder(docs.sparkSession)}/phrases-{uuid.uuid4().hex}", 0
        named = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
        coded = named.mapInArrow(_coded, "lang string, codes binary, words array<string>, counts array<long>")
        corpus = self.stored(coded.withColumn("block", F.monotonically_increasing_id()))
        words = corpus.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w")).select("block", "lang", "code", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
        sums = self.stored(words.groupBy("lang", "word").agg(F.sum("n").cast("long").alias("f")))
        self.totals = sums.groupBy("lang").agg(F.sum("f").cast("long").alias("n"))
        self.vocabulary = self.stored(ranked(sums.where(F.col("f") >= least), [], [F.col("f").desc(), F.col("lang").asc(), F.col("word").asc()], "number"))
        self.words, self.frequent = sums.agg(F.sum("f")).first()[0] or 0, self.vocabulary.count()
        self.shards = max(1, -(-self.words // shard_words))
        self.bits = max(1, int(self.frequent).bit_length())
        known = self.vocabulary.drop("f")
        numbers = words.drop("n").join(F.broadcast(known) if self.frequent <= BROADCAST_WORDS else known, ["lang", "word"])
        numbers = numbers.groupBy("block").agg(F.collect_list("code").alias("code"), F.collect_list(F.col("number").cast("int") if self.frequent < 2**31 else "number").alias("number"))
        here = self.stored(_met(corpus.select("block", "codes"), numbers, ["block"], _numbered, "block long, words binary, here binary"))
        self.dropped(corpus)
        self.levels: dict[int, DataFrame] = {}
        self.found: dict[int, DataFrame] = {}
        for m in range(2, longest + 1):
            here = self._level(m, here)

    def stored(self, df: DataFrame) -> DataFrame:
        """The table as written to the shared folder."""
        self.kept += 1
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{self.kept}")
        return self.spark.read.parquet(f"{self.folder}/{self.kept}")

    def dropped(self, df: DataFrame) -> None:
        """Remove a stored table that nothing reads any more."""
        for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            removed(self.spark, path)

    def _level(self, m: int, here: DataFrame) -> DataFrame:
        """Counts the phrases of `m` words; `here` with the numbers of the frequent ones."""
        bits, shards, least, more = self.bits, self.shards, self.least, m < self.longest

        def keys_at(words: bytes, now: bytes) -> tuple[np.ndarray, np.ndarray]:
            words = unpacked(words)
            now = unpacked(now) if now else words
            at = np.flatnonzero((now[:-1] >= 0) & (now[1:] >= 0)) if len(now) > 1 else np.zeros(0, np.int64)
            return at, (now[at] << bits) | words[at + m - 1]

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, words, now in zip(*(batch[c].to_pylist() for c in ("block", "words", "here")), strict=True):
                    keys, n = np.unique(keys_at(words, now)[1], return_counts=True)
                    shard = (spread(keys, 99) % np.uint64(shards)).astype(np.int64)
                    order = np.argsort(shard, kind="stable")
                    keys, n, edges = keys[order], n[order], np.searchsorted(shard[order], np.arange(shards + 1))
                    rows = [(s, block, packed(np.diff(keys[a:b], prepend=0)), packed(n[a:b])) for s, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if a < b]
                    yield from _table({"shard": pa.int64(), "block": pa.int64(), "keys": pa.binary(), "n": pa.binary()}, rows).to_batches()

        def counted(shard: pa.Table) -> pa.Table:
            number = shard["shard"][0].as_py()
            seen = [np.cumsum(unpacked(x)) for x in shard["keys"].to_pylist()]
            own = PerfectHash.of(np.unique(np.concatenate(seen)))
            slots = [own.slots(keys) for keys in seen]
            times = [unpacked(x) for x in shard["n"].to_pylist()]
            arrays = []
            for at in range(0, len(slots), ARRAY_BLOCKS):
                some = np.concatenate(slots[at : at + ARRAY_BLOCKS])
                arrays.append(np.bincount(some, np.concatenate(times[at : at + ARRAY_BLOCKS]), len(own.keys)).astype(np.int64))
            while len(arrays) > 1:
                arrays = [sum(arrays[k : k + 2]) for k in range(0, len(arrays), 2)]
            f = arrays[0]
            rank = np.where(f >= least, (np.cumsum(f >= least) - 1) * shards + number, -1)
            rows = [(number, own.sizes, np.packbits(own.bits).tobytes(), packed(own.keys), packed(f), int((f >= least).sum()), None, None, None)]
            for block, keys, slot in zip(shard["block"].to_pylist(), seen, slots, strict=True) if more else ():
                got = rank[slot] >= 0
                rows.append((number, None, None, None, None, None, block, packed(np.diff(keys[got], prepend=0)), packed(rank[slot[got]])))
            return _table(kinds, rows)

        def placed(rows: pa.Table, known: pa.Table) -> pa.Table:
            out = []
            keys = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(unpacked(x)) for x in known["seen"].to_pylist())])
            numbers = np.concatenate([np.zeros(0, np.int64), *(unpacked(x) for x in known["number"].to_pylist())])
            order = np.argsort(keys)
            keys, numbers = keys[order], numbers[order]
            for block, words, now in zip(*(rows[c].to_pylist() for c in ("block", "words", "here")), strict=True):
                at, asked = keys_at(words, now)
                then = np.full(len(unpacked(words)), -1, np.int64)
                if len(keys) and len(at):
                    i = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                    then[at] = np.where(keys[i] == asked, numbers[i], -1)
                out.append((block, words, packed(then)))
            return _table({"block": pa.int64(), "words": pa.binary(), "here": pa.binary()}, out)

        kinds = {"shard": pa.int64(), "sizes": pa.list_(pa.int64()), "bits": pa.binary(), "keys": pa.binary(), "f": pa.binary(), "size": pa.int64(), "block": pa.int64(), "seen": pa.binary(), "number": pa.binary()}
        seen = here.mapInArrow(dealt, "shard long, block long, keys binary, n binary")
        both = self.stored(seen.groupBy("shard").applyInArrow(counted, "shard long, sizes array<long>, bits binary, keys binary, f binary, size long, block long, seen binary, number binary"))
        level = self.levels[m] = both.where("block IS NULL").select("shard", "sizes", "bits", "keys", "f", "size")
        if self.bits + int(level.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0] * shards).bit_length() > 63:
            raise ValueError("too many frequent phrases for 63 bits")
        kept = self.stored(level.mapInArrow(_phrases(least, bits, shards), "number long, first long, last long, f long"))
        if m == 2:
            self.found[m] = kept.select("number", F.array("first", "last").alias("words"), "f")
        else:
            before = self.found[m - 1].select(F.col("number").alias("first"), F.col("words").alias("begin"))
            self.found[m] = self.stored(kept.join(before, "first").select("number", F.concat("begin", F.array("last")).alias("words"), "f"))
        if more:
            numbers = both.where("block IS NOT NULL").select("block", "seen", "number")
            then = self.stored(_met(here, numbers, ["block"], placed, "block long, words binary, here binary"))
        self.dropped(here)
        return then if more else here

    def counts(self, parts: DataFrame) -> DataFrame:
        """words and f of the distinct `parts` (words, numbers of frequent phrases), longer ones read by slot from their shards."""
        bits, shards, least = self.bits, self.shards, self.least
        word = self.vocabulary.select(F.col("number").alias("at"), "f")
        read = parts.withColumn("at", F.element_at("words", 1)).join(word, "at").select("words", "at", "f")
        done = read.where(F.size("words") == 1)
        for m in range(2, self.longest):

            def sharded(batches: Iterator[pa.RecordBatch], m: int = m) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    key = (batch["at"].to_numpy() << bits) | batch["last"].to_numpy()
                    shard = (spread(key, 99) % np.uint64(shards)).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"words": batch["words"], "key": key, "shard": shard})

            def looked_up(asked: pa.Table, shard: pa.Table) -> pa.Table:
                row = shard.to_pylist()[0]
                own, f = PerfectHash.from_columns(row | {"keys": unpacked(row["keys"]).tobytes()}), unpacked(row["f"])
                slots = own.slots(asked["key"].to_numpy())
                numbers = (np.cumsum(f >= least) - 1) * shards + row["shard"]
                return pa.table({"words": asked["words"], "at": numbers[slots], "f": f[slots]})

            asked = read.where(F.size("words") >= m).select("words", "at", F.element_at("words", m).alias("last")).mapInArrow(sharded, "words array<long>, key long, shard long")
            kinds = {"words": pa.list_(pa.int64()), "at": pa.int64(), "f": pa.int64()}
            read = self.stored(_met(asked, self.levels[m], ["shard"], _when_both(looked_up, kinds), "words array<long>, at long, f long"))
            done = done.unionByName(read.where(F.size("words") == m))
        return done.select("words", "f")

    def collocations(self, covered: int = COVERED, scale: int = SCALE) -> DataFrame:
        """lang, phrase, a, l, r, n, score of all candidates that no longer one covers."""
        rows = None
        for m, found in self.found.items():
            own = found.select("words", F.col("f").alias("a"))
            if m < self.longest:  # a longer phrase is never more frequent, so the next level decides
                longer = self.found[m + 1].select(F.explode(F.array(F.slice("words", 1, m), F.slice("words", 2, m))).alias("words"), F.col("f").alias("more"))
                longer = longer.groupBy("words").agg(F.max("more").alias("more"))
                own = own.join(longer, "words", "left").where(F.coalesce(100 * F.col("more") < covered * F.col("a"), F.lit(True))).drop("more")
            rows = own if rows is None else rows.unionByName(own)
        cut = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
        cut = cut.withColumn("begin", F.slice("words", F.lit(1), F.col("k"))).withColumn("end", F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")))
        parts = cut.select(F.explode(F.array("begin", "end")).alias("words")).distinct()
        known = self.stored(self.counts(parts))
        cut = cut.join(known.select(F.col("words").alias("begin"), F.col("f").alias("l")), "begin").join(known.select(F.col("words").alias("end"), F.col("f").alias("r")), "end")

        def wide(c: str):
            return F.col(c).cast("decimal(15,0)")

        cut = cut.withColumn("product", wide("a") * wide("a") * F.lit(scale).cast("decimal(8,0)")).withColumn("score", F.expr("CAST(product AS DECIMAL(38,0)) div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))"))
        best = cut.groupBy("words").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("words", "b.a", "b.l", "b.r", "b.score")
        named = best.select("*", F.posexplode("words").alias("i", "number")).join(self.vocabulary.select("number", "lang", "word"), "number")
        phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase")
        texts = named.groupBy("words", "a", "l", "r", "score").agg(F.first("lang").alias("lang"), phrase)
        return texts.join(self.totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def _met(a: DataFrame, b: DataFrame, by: list[str], work, schema: str) -> DataFrame:
    """`work` on the rows of `a` and of `b` that have the same key."""
    b = b.select(*(F.col(c).alias(c) for c in b.columns))  # both may come from one table
    return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(work, schema)


def _table(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.table({name: pa.array(values, kind) for (name, kind), values in zip(kinds.items(), columns, strict=True)})


def _when_both(work, kinds: dict[str, pa.DataType]):
    """`work` on the two tables of a group, or no rows if one is empty."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return work(a, b) if a.num_rows and b.num_rows else _table(kinds, [])

    return run


def _numbered(codes: pa.Table, known: pa.Table) -> pa.Table:
    """block and words: the number of each position's word, -1 for rare words and ends of pieces."""
    rows = []
    for block, own in zip(codes["block"].to_pylist(), codes["codes"].to_pylist(), strict=True):
        own = unpacked(own)
        number = np.full(int(own.max()) + 2, -1, np.int64)
        for code, value in zip(known["code"].combine_chunks(), known["number"].combine_chunks(), strict=True):
            number[code.values.to_numpy(zero_copy_only=False)] = value.values.to_numpy(zero_copy_only=False)
        rows.append((block, packed(number[own]), None))
    return _table({"block": pa.int64(), "words": pa.binary(), "here": pa.binary()}, rows)


def _phrases(least: int, bits: int, shards: int):
    """The frequent phrases of shards: number, first words' number, last word and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["shard", "keys", "f"]).to_pylist():
                f, keys = unpacked(row["f"]), unpacked(row["keys"])
                keep = f >= least
                keys = keys[keep]
                yield pa.RecordBatch.from_pydict({"number": np.arange(len(keys)) * shards + row["shard"], "first": keys >> bits, "last": keys & ((1 << bits) - 1), "f": f[keep]})

    return run


def ranked_collocations(docs: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """The first `top` of each language by score, count and phrase."""
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    rows = Phrases(docs, longest, least).collocations()
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f AS (
  SELECT lang, x, count(*) AS f FROM (
    SELECT lang, unnest(flatten(list_transform([1, 2, 3], lambda m: list_transform(range(1, greatest(1, len(w) - m + 2)), lambda i: w[i:i + m - 1])))) AS x FROM w) t
  GROUP BY lang, x),
n AS (SELECT lang, sum(f) AS n FROM f WHERE len(x) = 1 GROUP BY lang),
c AS (SELECT lang, x, f AS a FROM f WHERE len(x) > 1 AND f >= 10),
u AS (SELECT lang, part, max(a) AS more FROM (SELECT lang, unnest([x[1:2], x[2:3]]) AS part, a FROM c WHERE len(x) = 3) t GROUP BY lang, part),
k AS (
  SELECT c.lang, c.x, c.a FROM c LEFT JOIN u ON u.lang = c.lang AND u.part = c.x AND len(c.x) = 2 WHERE u.more IS NULL OR 100 * u.more < 50 * c.a),
q AS (
  SELECT k.lang, k.x, k.a, g.k, l.f AS l, r.f AS r, (CAST(k.a AS HUGEINT) * k.a * 1000000) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM k JOIN (VALUES (1), (2)) g(k) ON g.k < len(k.x)
  JOIN f l ON l.lang = k.lang AND l.x = k.x[1:g.k] JOIN f r ON r.lang = k.lang AND r.x = k.x[g.k + 1:]),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(x, ' ')) AS rank, array_to_string(x, ' ') AS phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM b JOIN n ON n.lang = b.lang QUALIFY rank <= 2000
"""
