"""Quality figures: precision and recall, graded identifiers, percentiles, gates, leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import ranked

from ..functions.text import compact, digits_form, let, strong_form


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Precision, recall and F1 for each type and over all (type NULL): sets of values (page_id, type, value)."""
    key = ["page_id", "type", "value"]
    t, f = truth.select(*key).distinct().withColumn("t", F.lit(1)), found.select(*key).distinct().withColumn("f", F.lit(1))
    both = t.join(f, key, "full_outer")
    n = both.rollup("type").agg(F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("type", tp, fp, fn, ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def graded(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Grade of each true identifier (page_id, value): exact, near_miss (equal after normalising) or miss."""
    exact = found.select("page_id", "value").distinct().withColumn("_e", F.lit(1))
    near = found.select("page_id", digits_form(F.col("value")).alias("_v")).distinct().withColumn("_n", F.lit(1))
    t = truth.select("page_id", "value").distinct().withColumn("_v", digits_form(F.col("value")))
    grade = F.when(F.col("_e").isNotNull(), "exact").when(F.col("_n").isNotNull(), "near_miss").otherwise("miss")
    return t.join(exact, ["page_id", "value"], "left").join(near, ["page_id", "_v"], "left").select("page_id", "value", grade.alias("grade"))


def confusions(truth: DataFrame, found: DataFrame, most: int = 10) -> DataFrame:
    """Right text, wrong type: the most frequent pairs of types."""
    t, f = truth.select("page_id", "value", F.col("type").alias("true_type")).distinct(), found.select("page_id", "value", F.col("type").alias("found_type")).distinct()
    n = t.join(f, ["page_id", "value"]).where("true_type != found_type").groupBy("true_type", "found_type").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "true_type", "found_type").limit(most)


def percentiles(df: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99), by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, greatest, sum and exact percentiles with linear interpolation at (n - 1) p; by ranks, so a group of any size will do."""
    keys = list(by)
    rows = ranked(df.select(*keys, value).where(F.col(value).isNotNull()), keys, [F.col(value)], "_rank")
    sizes = df.groupBy(*keys).agg(F.count(value).alias("_n"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.sum(value).alias("total"))
    sizes = sizes.select(*(F.col(k).alias(f"_by{i}") for i, k in enumerate(keys)), "_n", "mean", "max", "total")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_by{i}"))
    out, place = [], F.col("_rank") - 1
    for p in shares:
        at = (F.col("_n") - 1) * F.lit(p)
        low, high = (F.max(F.when(place == f(at), F.col(value))) for f in (F.floor, F.ceil))
        out.append((low + (high - low) * F.first(at - F.floor(at))).alias(f"p{round(p * 100)}"))
    figures = [F.first(c).alias(c) for c in ("mean", "max", "total")]
    return rows.join(F.broadcast(sizes) if not keys else sizes, same).groupBy(*keys).agg(*figures, *out)


def throughput(pages: DataFrame, warm_up: int = 1) -> DataFrame:
    """Pages a minute of each run (run, seq, seconds) without its first ones."""
    return pages.where(F.col("seq") > warm_up).groupBy("run").agg((F.count("*") * 60 / F.sum("seconds")).alias("pages_per_minute"))


def gates(now: DataFrame, baseline: DataFrame, slack: float = 0.01) -> DataFrame:
    """(type, recall_ok, precision_ok): recall at most a point below the baseline, precision not below it."""
    b = baseline.select("type", F.col("recall").alias("r0"), F.col("precision").alias("p0"))
    return now.join(b, now["type"].eqNullSafe(b["type"])).select(now["type"], (F.col("recall") >= F.col("r0") - slack).alias("recall_ok"), (F.col("precision") >= F.col("p0")).alias("precision_ok"))


def matrix(cells: DataFrame, rows: DataFrame, columns: DataFrame, value: str) -> DataFrame:
    """A value for each row and column of a full grid; pairs that never ran stay null, which isn't zero."""
    return rows.crossJoin(columns).join(cells.select(*rows.columns, *columns.columns, value), [*rows.columns, *columns.columns], "left")


def tiers(cells: DataFrame) -> DataFrame:
    """(format, tier) from gates passed by mode: all, some or none."""
    t = F.when(F.bool_and("passed"), "supported").when(F.bool_or("passed"), "partial").otherwise("unsupported")
    return cells.groupBy("format").agg(t.alias("tier"), F.count_if("passed").alias("passed"), F.count("*").alias("cells"))


#: Bytes of the pieces by which originals and products are joined; one in so many pieces is used, by its hash. Most originals without one that are broadcast.
GRAM, SAMPLE, SHORT = 24, 8, 1000


def _pieces(form: Column, size: int, sample: int) -> Column:
    """Hashes of all pieces of so many bytes, of one in `sample`."""

    def used(raw: Column) -> Column:
        at = F.when(F.octet_length(raw) >= size, F.sequence(F.lit(1), F.octet_length(raw) - size + 1))
        hashes = F.transform(at, lambda i: F.xxhash64(F.substring(raw, i, F.lit(size))))
        return hashes if sample == 1 else F.filter(hashes, lambda h: F.pmod(h, F.lit(sample)) == 0)

    return let(form.cast("binary"), used)  # once for all positions; as bytes, for positions in strings are counted from the start


def leaks(originals: DataFrame, products: DataFrame, least: int = 4, short: int = SHORT) -> DataFrame:
    """(doc_id, item_id) where a product's normalised text contains a normalised original, in any script.

    Originals of the same normalised form are compared once. The pairs are
    limited by a shared piece of the normalised form: a product that contains
    an original has all its pieces, wherever words are broken or joined, and
    which pieces are used depends on them alone. Originals without a used piece
    (shorter than one, or by chance) are broadcast if they are at most `short`;
    more of them are joined by their first bytes, as many as a piece or all.
    """
    items = originals.select("item_id", strong_form(F.col("text")).alias("o")).where(F.char_length("o") >= least)
    texts = products.select("doc_id", strong_form(F.col("text")).alias("p"))
    forms = items.select("o").distinct().select("o", F.array_min(_pieces(F.col("o"), GRAM, SAMPLE)).alias("piece"))

    def met(probes: DataFrame, keyed: DataFrame, by: list[str]) -> DataFrame:
        near = probes.join(keyed, by).select(F.col("doc_id").alias("near_id"), "o").distinct()
        return near.join(texts, F.col("near_id").eqNullSafe(F.col("doc_id"))).where(F.col("p").contains(F.col("o"))).select("doc_id", "o")

    probes = texts.select("doc_id", F.explode(F.array_distinct(_pieces(F.col("p"), GRAM, SAMPLE))).alias("piece"))
    found = met(probes, forms.where(F.col("piece").isNotNull()), ["piece"])
    rest = forms.where(F.col("piece").isNull()).select("o", F.least(F.octet_length("o"), F.lit(GRAM)).alias("size"))
    sizes = rest.groupBy("size").count().collect()  # at most GRAM rows
    if sum(r["count"] for r in sizes) <= short:
        found = found.union(texts.join(F.broadcast(rest), F.col("p").contains(F.col("o"))).select("doc_id", "o"))
    else:
        keyed = rest.withColumn("piece", F.xxhash64(F.substring(F.col("o").cast("binary"), F.lit(1), F.col("size"))))
        for r in sizes:
            probes = texts.select("doc_id", F.explode(F.array_distinct(_pieces(F.col("p"), r["size"], 1))).alias("piece"))
            found = found.union(met(probes, keyed.where(F.col("size") == r["size"]), ["piece"]))
    return found.join(items, "o").select("doc_id", "item_id").distinct()


def admitted(entries: DataFrame, types: list[str]) -> DataFrame:
    """Adds `reason`: why a hard case (text, spans of type and value) is refused, or null."""
    bad_type = F.exists("spans", lambda s: ~s["type"].isin(*types))
    absent = F.exists("spans", lambda s: ~compact(F.col("text")).contains(compact(s["value"])))
    bad_id = F.exists("spans", lambda s: (s["type"] == "ID_CARD") & ~s["value"].rlike("^[0-9]{17}[0-9Xx]$"))
    return entries.withColumn("reason", F.when(bad_type, "unknown_type").when(absent, "value_not_in_text").when(bad_id, "bad_id_format"))
