"""Jobs, their items, files and audit events: states, figures, lists, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import ranked, running_sum

# The states and the moves between them.
JOB_MOVES = {
    "draft": ("queued", "processing", "cancelled"),
    "queued": ("processing", "cancelled"),
    "processing": ("awaiting_review", "completed", "failed", "cancelled"),
    "awaiting_review": ("processing", "completed", "failed", "cancelled"),
    "completed": ("queued",),
    "failed": ("queued", "processing", "cancelled"),
    "cancelled": (),
}
ITEM_MOVES = {
    "pending": ("processing", "awaiting_review", "cancelled"),
    "processing": ("awaiting_review", "completed", "failed"),
    "awaiting_review": ("processing", "completed", "failed"),
    "completed": (),
    "failed": ("pending", "processing"),
}
ACTIVE_JOBS = ("queued", "processing", "running", "redacting")
REVIEW_ITEMS = ("awaiting_review", "review_approved")
ACTIVE_ITEMS = ("pending", "queued", "processing", "parsing", "ner", "vision", "redacting")
RISK = ("failed", "cancelled")
STATUS_GROUPS = {"active": ACTIVE_JOBS, "risk": RISK}
ITEM_STATES = ("pending", "processing", "awaiting_review", "completed", "failed")


def _n(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def job_stats(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """One row: jobs and items by class of status."""
    s = F.col("status")
    j = jobs.agg(
        F.count("*").alias("total_jobs"), _n(s == "draft", "draft_jobs"), _n(s.isin(*ACTIVE_JOBS), "active_jobs"),
        _n(s == "awaiting_review", "awaiting_review_jobs"), _n(s == "completed", "completed_jobs"), _n(s.isin(*RISK), "risk_jobs"),
    )
    i = items.join(jobs.select(F.col("job_id")), "job_id", "left_semi").agg(
        F.count("*").alias("total_items"), _n(s.isin(*ACTIVE_ITEMS), "active_items"), _n(s.isin(*REVIEW_ITEMS), "awaiting_review_items"),
        _n(s == "completed", "completed_items"), _n(s.isin(*RISK), "risk_items"),
    )
    return j.join(i, F.lit(True))  # one row each


def progress(items: DataFrame) -> DataFrame:
    """Items of each job by status, zeros included."""
    return items.groupBy("job_id").agg(*(_n(F.col("status") == s, s) for s in ITEM_STATES), F.count("*").alias("total"))


def derived_status(items: DataFrame) -> DataFrame:
    """(job_id, status) by the queue's rule: open items first, then all done, all failed, waiting, done with failures."""
    s = F.col("status")
    return items.groupBy("job_id").agg(
        F.when(F.bool_or(s == "processing"), "processing")
        .when(F.bool_or(s == "pending"), "queued")
        .when(F.bool_and(s == "completed"), "completed")
        .when(F.bool_and(s == "failed"), "failed")
        .when(F.bool_or(s == "awaiting_review"), "awaiting_review")
        .otherwise("completed")
        .alias("status")
    )


def derived_status_simple(items: DataFrame) -> DataFrame:
    """The plain cascade: any failure makes the job failed once nothing is open."""
    s = F.col("status")
    return items.groupBy("job_id").agg(
        F.when(F.bool_or(s.isin("pending", "processing")), "processing")
        .when(F.bool_or(s == "failed"), "failed")
        .when(F.bool_or(s == "awaiting_review"), "awaiting_review")
        .otherwise("completed")
        .alias("status")
    )


def illegal_moves(history: DataFrame, moves: dict[str, tuple[str, ...]]) -> DataFrame:
    """Steps (id, seq, before, status) that no move allows; staying is allowed."""
    legal = F.create_map(*(x for a, bs in moves.items() for x in (F.lit(a), F.array(*map(F.lit, bs)).cast("array<string>"))))
    before = F.lag("status").over(Window.partitionBy("id").orderBy("seq"))
    steps = history.withColumn("before", before).where("before IS NOT NULL AND before != status")
    ok = F.array_contains(F.coalesce(F.try_element_at(legal, F.col("before")), F.array().cast("array<string>")), F.col("status"))
    return steps.where(~ok).select("id", "seq", "before", "status")


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; one aggregation, no sort."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both; new ones replace old ones of the same key."""
    return latest(old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1))), key, ["_v"]).drop("_v")


def without_keys(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A delete that cascades by key."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def filtered_jobs(jobs: DataFrame, job_type: str | None = None, status: str | None = None, owner: str | None = None) -> DataFrame:
    """By type, by status or group of them (active, risk), by owner; an unknown status is an error."""
    if status:
        known = STATUS_GROUPS.get(status) or ((status,) if status in JOB_MOVES or status in ACTIVE_JOBS else None)
        if known is None:
            raise ValueError(f"unknown status: {status}")
        jobs = jobs.where(F.col("status").isin(*known))
    if job_type:
        jobs = jobs.where(F.col("job_type") == job_type)
    return jobs.where(F.col("owner_id") == owner) if owner else jobs


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of a sorted list; sizes from 1 to 100. `order` should end with a unique column."""
    size = min(max(size, 1), 100)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def newest_groups_first(files: DataFrame) -> DataFrame:
    """Adds `group_newest`; sort by it descending, then by group and time."""
    return files.withColumn("group_newest", F.max("created_at").over(Window.partitionBy("group_id")))


def schedule(tasks: DataFrame) -> DataFrame:
    """Adds `place`: by class, priority, work units and order of arrival."""
    return ranked(tasks, [], [F.col(c) for c in ("task_class", "priority", "work_units", "seq")], "place")


def stale(items: DataFrame, cutoff: Column) -> DataFrame:
    """Items in work without a sign of life since the cutoff."""
    return items.where((F.col("status") == "processing") & (F.coalesce("progress_updated_at", "updated_at") < cutoff))


def expired(files: DataFrame, now: Column, days: int) -> DataFrame:
    return files.where(F.coalesce("deleted_at", "created_at") < now - F.make_interval(days=F.lit(days)))


def repaired(items: DataFrame) -> DataFrame:
    """Status after a crash: work in flight waits again, finished work without output is redone, failed work with output is done."""
    s = F.col("status")
    fixed = (
        F.when(s.isin("processing", "parsing", "ner", "vision", "queued") & F.col("has_entities"), "awaiting_review")
        .when(s.isin("processing", "parsing", "ner", "vision", "queued"), "pending")
        .when((s == "completed") & ~F.col("has_output"), "awaiting_review")
        .when((s == "failed") & F.col("has_output"), "completed")
        .otherwise(s)
    )
    return items.withColumn("status", fixed)


def approved(items: DataFrame, ids: DataFrame, reviewer: str) -> DataFrame:
    """All waiting items of a list are approved at once."""
    hit = items.join(ids.select("item_id").distinct().withColumn("_hit", F.lit(True)), "item_id", "left")
    yes = F.col("_hit").isNotNull() & (F.col("status") == "awaiting_review")
    return hit.withColumn("reviewer", F.when(yes, reviewer).otherwise(F.col("reviewer"))).withColumn("status", F.when(yes, "completed").otherwise(F.col("status"))).drop("_hit")


def blocking_reasons(items: DataFrame) -> DataFrame:
    """Adds `reasons` and `delivery`: what keeps an item (status, has_output, skip_reason, confirmed, selected) from delivery."""
    found = F.array(
        F.when(F.col("status") == "failed", "failed"),
        F.when(~F.col("has_output"), "missing_redacted_output").otherwise(F.col("skip_reason")),
        F.when(~F.col("confirmed"), "review_not_confirmed"),
    )
    reasons = F.array_distinct(F.filter(found, lambda x: x.isNotNull()))
    out = items.withColumn("reasons", reasons)
    return out.withColumn("delivery", F.when(~F.col("selected"), "not_selected").when(F.size("reasons") == 0, "ready_for_delivery").otherwise("action_required"))


def delivery_summary(items: DataFrame) -> DataFrame:
    """One row over items with reasons: totals, coverage, what is in the archive and what isn't."""
    ready = F.col("delivery") == "ready_for_delivery"
    t = items.agg(
        F.count("*").alias("total"), _n(F.col("selected"), "n_selected"), _n(ready, "included"), _n(F.col("selected") & ~ready, "action_required"),
        _n(F.col("has_output"), "with_output"),
    )
    status = F.when(F.col("n_selected") == 0, "no_selection").when(F.col("action_required") == 0, "ready_for_delivery").otherwise("action_required")
    return t.withColumn("status", status)


def owner_counts(files: DataFrame, data: str, default: str) -> DataFrame:
    """Files of each owner named in a JSON document, deleted ones left out."""
    owner = F.coalesce(F.nullif(F.get_json_object(data, "$.owner_id"), F.lit("")), F.lit(default))
    return files.where(F.get_json_object(data, "$.deleted_at").isNull()).groupBy(owner.alias("owner")).agg(F.count("*").alias("n_files"))


def audit_search(events: DataFrame, user: str | None = None, action: str | None = None, resource_type: str | None = None, q: str | None = None) -> DataFrame:
    """By equal names whatever their case, and by a part of the whole event as JSON."""
    for name, value in (("user", user), ("action", action), ("resource_type", resource_type)):
        if value:
            events = events.where(F.lower(name) == value.lower())
    return events.where(F.lower(F.to_json(F.struct(*events.columns))).contains(q.lower())) if q else events


def volumes(files: DataFrame, max_files: int = 1000, max_bytes: int = 2 << 30, group: str = "job_id") -> DataFrame:
    """Adds `volume`: files in order (pos, n_bytes) fill a volume until the next would exceed a cap.

    Where a volume starts depends on all before, so it is one fold over a job's
    positions and sizes (16 bytes a file); it only keeps the starts, and the
    volumes of all files are a running count of them.
    """
    long = lambda x: F.lit(x).cast("long")
    start = F.struct(long(0).alias("n"), long(0).alias("b"), F.array().cast("array<bigint>").alias("starts"))

    def step(a: Column, x: Column) -> Column:
        new = (a["n"] == 0) | (a["n"] + 1 > max_files) | (a["b"] + x["n_bytes"] > max_bytes)
        return F.struct(
            F.when(new, long(1)).otherwise(a["n"] + 1).alias("n"),
            F.when(new, x["n_bytes"]).otherwise(a["b"] + x["n_bytes"]).alias("b"),
            F.when(new, F.array_append(a["starts"], x["pos"])).otherwise(a["starts"]).alias("starts"),
        )

    f = files.select(group, F.col("pos").cast("long").alias("pos"), F.col("n_bytes").cast("long").alias("n_bytes"))
    sizes = f.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("pos", "n_bytes"))).alias("f"))
    starts = sizes.select(group, F.explode(F.aggregate("f", start, step)["starts"]).alias("pos")).withColumn("first", F.lit(1))
    marked = f.join(starts, [group, "pos"], "left")
    return running_sum(marked, [group], [F.col("pos")], F.coalesce("first", F.lit(0)).cast("long"), "volume").select(group, "pos", "volume")


def archive_names(files: DataFrame) -> DataFrame:
    """Adds `archive_name`: a repeated name (whatever its case) gets its number in front."""
    w = Window.partitionBy(F.lower("name")).orderBy("pos")
    n = F.row_number().over(w)
    return files.withColumn("archive_name", F.when(n == 1, F.col("name")).otherwise(F.concat((n - 1).cast("string"), F.lit("_"), "name")))
