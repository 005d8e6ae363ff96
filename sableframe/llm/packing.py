"""Best-fit packing into sequences of several permitted lengths.

Texts longer than the largest length give full sequences of their own and a
rest. Rests are dealt into shards of bounded size by a hash; a shard packs its
rests, longest first, into the open bin with the least room left. If none has
room, the bin size with the least cost for each token it can still receive is
opened: a sequence has a cost of its own, beside that of its length and of its
square, so a middle size wins while there is enough left to fill it, a small one
when little is left, and the largest only for what needs it. At the end every
bin shrinks to the smallest size for its contents. `sequences` joins the places
with token ids into whole sequences and the starts of their parts.

Null and empty texts have no tokens: one row with no bin and capacity 0.
Repeated rows are packed each on its own; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Permitted lengths, and the cost of a sequence in tokens: its own, its length, and attention's square.
CAPACITIES = (512, 1024, 2048, 4096)
OWN_COST, SQUARE_AT = 512, 8192
SHARD_ROWS = 20_000
SCHEMA = "doc_id long, piece long, start_token long, n_tokens long, bin_id long, bin_capacity long, bin_offset long"


def cost(capacity: int, own: int = OWN_COST, square_at: int = SQUARE_AT) -> float:
    return own + capacity * (1 + capacity / square_at)


def pack(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES) -> list[tuple[int, int, int]]:
    """Bin number, offset and final capacity for each size, none over the largest capacity.

    Open bins stand by their free room; a bit for each room in use finds the
    tightest fit. Equal sizes keep their order.
    """
    capacities = tuple(sorted(capacities))
    left = sum(sizes)
    by_room: dict[int, list[int]] = {}
    rooms = 0
    used: list[int] = []
    at: list[tuple[int, int]] = [(-1, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room = min((c for c in capacities if c >= size), key=lambda c: (cost(c) / max(1, min(c, left)), c))
            b = len(used)
            used.append(0)
        at[i] = (b, used[b])
        used[b] += size
        left -= size
        room -= size
        if room:
            by_room.setdefault(room, []).append(b)
            rooms |= 1 << room
    final = [next(c for c in capacities if c >= n) for n in used]
    return [(b, offset, final[b]) for b, offset in at]


def token_count(text: Column) -> Column:
    """Words, the token unit here: runs without ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def packed(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, shard_rows: int = SHARD_ROWS, tokens: Column | None = None) -> DataFrame:
    """One row for each piece of each row of `docs` (doc_id, text): its bin and place."""
    largest = max(capacities)
    shards = max(1, -(-docs.count() // shard_rows))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (token_count(F.col("text")) if tokens is None else tokens).alias("n"))
    # The row's place keeps many repeated rows from meeting in one shard.
    dealt = sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n", F.monotonically_increasing_id()), F.lit(shards)))

    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def fill(shard: pa.Table) -> pa.Table:
        rows_in = sorted(zip(shard["n"].to_pylist(), shard["doc_id"].to_pylist(), strict=True), key=lambda r: (r[0], r[1] is None, r[1] or 0))
        base = shard["shard"][0].as_py() << 32
        places = iter(pack([n % largest for n, _ in rows_in if n % largest], capacities))
        own = 1 << 31  # bins of full pieces are numbered from here on
        rows: list[tuple] = []
        for n, doc_id in rows_in:
            for piece in range(n // largest):
                rows.append((doc_id, piece, piece * largest, largest, base + own, largest, 0))
                own += 1
            if rest := n % largest:
                b, offset, capacity = next(places)
                rows.append((doc_id, n // largest, n - rest, rest, base + b, capacity, offset))
            elif not n:
                rows.append((doc_id, 0, 0, 0, None, 0, 0))
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return dealt.groupBy("shard").applyInArrow(fill, SCHEMA)


def sequences(places: DataFrame, ids: DataFrame) -> DataFrame:
    """bin_id, bin_capacity, ids, starts and doc_ids of each bin, from `packed` and ids (doc_id, ids array<int>).

    `packed` must have counted these ids (tokens=F.size("ids")) and doc_id must
    be unique in `ids`. A bin holds at most its capacity, so groups are bounded.
    """
    parts = places.where("bin_id IS NOT NULL").join(ids.select("doc_id", "ids"), "doc_id")
    part = F.slice("ids", (F.col("start_token") + 1).cast("int"), F.col("n_tokens").cast("int"))
    one = F.struct(F.col("bin_offset").cast("int").alias("start"), "doc_id", part.alias("ids"))
    bins = parts.groupBy("bin_id", "bin_capacity").agg(F.sort_array(F.collect_list(one)).alias("parts"))
    return bins.select(
        "bin_id",
        "bin_capacity",
        F.flatten(F.col("parts.ids")).alias("ids"),
        F.col("parts.start").alias("starts"),
        F.col("parts.doc_id").alias("doc_ids"),
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
