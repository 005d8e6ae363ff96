"""Hard negatives for anchors among labelled vectors: a full sort of each anchor's scores.

Components are scaled and floored to integers, so scores are exact. An anchor's
positives are its best rows of its own label. A negative of a positive is a row
of another label whose score lies between two shares of the positive's score.

Anchors and rows are dealt into blocks of bounded size by a hash, and every
block of anchors meets every block of rows in a task of its own: the anchors are
a stated set of queries against all rows. A first round takes the best rows of
the anchor's label from each tile, a second the negatives: scores of a tile are
sorted by score and id, each positive's upper limit is found by binary search,
and the first rows of another label at or above the lower limit are read. A
window over what the tiles return (a few rows each) settles both rounds.

Rows with a null label, a null vector, or a null or non-finite component take no
part. Shorter vectors count as padded with zeros, so an empty one scores 0. A
null id is no anchor and comes last among ties. Rows that repeat id, label and
vector count each time as positives and negatives and once as an anchor; a row
with the anchor's id isn't its positive. Scores tie by the smaller id. A
positive with a negative score has no negatives, as its limits cross. Scores
beyond 64 bits are an error. An empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Scale of a component, positives of an anchor, negatives of a positive, and the limits as percentages of the positive's score.
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Rows and anchors of a block, and the anchors whose scores are held at once.
ROWS, ANCHORS, AT_ONCE = 8192, 8192, 64
LAST = np.iinfo(np.int64).max


def whole(rows: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """vec_id, label, q (array<bigint>) of the rows that take part, with `copies` of each."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = rows.where(label.isNotNull() & F.col("embedding").isNotNull() & finite)
    q = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), q.alias("q")).groupBy("vec_id", "label", "q").agg(F.count("*").alias("copies"))


def matrix(q: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows of integers, padded to `width`."""
    q = q.combine_chunks() if isinstance(q, pa.ChunkedArray) else q
    lengths = q.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = q.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exactly: by floating point where it can hold every sum, in Python's integers where 64 bits can't."""
    most = max(1, a.shape[1]) * (int(np.abs(a).max(initial=0)) or 1) * (int(np.abs(b).max(initial=0)) or 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    return np.array((a.astype(object) @ b.T.astype(object)).tolist(), dtype=np.int64).reshape(len(a), len(b))


class Tile:
    """A block of anchors and a block of rows as arrays; rows stand in order of id."""

    def __init__(self, anchors: pa.Table, rows: pa.Table, most: int):
        width = max(x["q"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0) for x in (anchors, rows))
        copies = np.minimum(rows["copies"].to_numpy(), most)
        ids = rows["vec_id"].fill_null(LAST).to_numpy()
        order = np.repeat(np.argsort(ids, kind="stable"), copies[np.argsort(ids, kind="stable")])
        self.ids, self.labels = ids[order], rows["label"].to_numpy()[order]
        self.q, self.anchors_q = matrix(rows["q"], width)[order], matrix(anchors["q"], width)
        self.anchor, self.anchor_ids, self.anchor_labels = (anchors[c].fill_null(LAST).to_numpy() for c in ("anchor", "anchor_id", "label"))


def best_of_label(tile: Tile, k: int) -> dict[str, list]:
    """For each anchor the tile's first `k` other rows of its label, by score and id."""
    found: dict[str, list] = {"anchor": [], "id": [], "score": []}
    for label in np.unique(tile.anchor_labels):
        mine, own = np.flatnonzero(tile.anchor_labels == label), np.flatnonzero(tile.labels == label)
        for at in range(0, len(mine), AT_ONCE):
            part = mine[at : at + AT_ONCE]
            for a, scores in zip(part, products(tile.anchors_q[part], tile.q[own]), strict=True):
                others = tile.ids[own] != tile.anchor_ids[a]
                ids, scores = tile.ids[own][others], scores[others]
                first = np.lexsort((ids, -scores))[:k]
                found["anchor"] += [tile.anchor[a]] * len(first)
                found["id"] += ids[first].tolist()
                found["score"] += scores[first].tolist()
    return found


def between(tile: Tile, limits: list[list[int]], k: int, low: int, high: int) -> dict[str, list]:
    """For each anchor and each score of its positives the tile's first `k` rows of another label within the limits."""
    found: dict[str, list] = {"anchor": [], "positive_score": [], "id": [], "score": []}
    for at in range(0, len(limits), AT_ONCE):
        for a, scores in enumerate(products(tile.anchors_q[at : at + AT_ONCE], tile.q), at):
            order = np.lexsort((tile.ids, -scores))
            order = order[tile.labels[order] != tile.anchor_labels[a]]
            falling, ids = -scores[order], tile.ids[order]
            for p in limits[a]:
                upper, lower = high * p // 100, -(-low * p // 100)
                i = int(np.searchsorted(falling, -upper))
                j = min(i + k, int(np.searchsorted(falling, -lower, side="right")))
                if i < j:
                    found["anchor"] += [tile.anchor[a]] * (j - i)
                    found["positive_score"] += [p] * (j - i)
                    found["id"] += ids[i:j].tolist()
                    found["score"] += (-falling[i:j]).tolist()
    return found


def _arrow(found: dict[str, list]) -> pa.Table:
    ids = [None if x == LAST else x for x in found["id"]]
    return pa.table({c: pa.array(ids if c == "id" else v, pa.int64()) for c, v in found.items()})


def mined(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block: int = ROWS,
    anchor_block: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `rows` has vec_id, label, q and copies, as `whole` gives them. `low` and
    `high` are percentages of the positive's score.
    """
    rows = checkpointed(rows)
    # The anchors' numbers are kept with them, so they don't change if a task is run again.
    anchors = checkpointed(rows.where(is_anchor).select(F.monotonically_increasing_id().alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "q"))
    n_rows, n_anchors = rows.count(), anchors.count()
    across, down = max(1, -(-n_rows // block)), max(1, -(-n_anchors // anchor_block))
    tiles = 2 * across * down

    def dealt(df: DataFrame, key: list[str], own: int, other: int, tile: Column) -> DataFrame:
        cut = df.select(*(F.col(c).alias(c) for c in df.columns)).withColumn("_own", F.pmod(F.xxhash64(*key), F.lit(own))).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
        return cut.withColumn("tile", tile.cast("int")).drop("_own", "_other").repartition(tiles, "tile").groupBy("tile")

    by_rows = dealt(rows, ["vec_id", "label", "q"], across, down, F.col("_other") * across + F.col("_own"))

    def of_anchors(df: DataFrame):
        return dealt(df, ["anchor"], down, across, F.col("_own") * across + F.col("_other"))

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return _arrow({"anchor": [], "id": [], "score": []})
        return _arrow(best_of_label(Tile(a, b, positives), positives))

    ordered = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    near = of_anchors(anchors).cogroup(by_rows).applyInArrow(nearest, "anchor long, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(*ordered))
    best = checkpointed(near.withColumn("place", place).where(F.col("place") <= positives))
    limits = best.where("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set("score")).alias("limits"))

    def hard(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return _arrow({"anchor": [], "positive_score": [], "id": [], "score": []})
        return _arrow(between(Tile(a, b, negatives), a["limits"].to_pylist(), negatives, low, high))

    asked = anchors.join(limits, "anchor")
    hits = of_anchors(asked).cogroup(by_rows).applyInArrow(hard, "anchor long, positive_score long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "positive_score").orderBy(*ordered))
    kept = hits.withColumn("rank", rank).where(F.col("rank") <= negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    pairs = best.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(kept, ["anchor", "positive_score"]).join(anchors.select("anchor", "anchor_id"), "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(whole(table(spark, sf_dir, "embeddings"), label), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label,
         CAST(list_sum(list_transform(list_zip(a.q, r.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM r a JOIN r ON a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 3
"""
