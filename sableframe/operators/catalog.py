"""Lists, lookups and figures over files, types, entities and risks, as plain relational operators.

All of them are projections, aggregations and equi-joins. Small dimensions
(types, overrides) are left to the optimiser, which broadcasts them by their
measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The order of severities, limits of lists, and confidence classes.
SEVERITIES = ("critical", "high", "medium", "low", "info")
MOST_CANDIDATES = 50_000
HIGH_CONFIDENCE, MEDIUM_CONFIDENCE = 0.8, 0.5
#: Kinds of file that a kind of job takes.
JOB_FILE_TYPES = {"text_only": ("txt", "docx", "pdf", "md", "html"), "image_only": ("jpg", "png", "scanned_pdf"), "smart_batch": ("txt", "docx", "pdf", "md", "html", "jpg", "png", "scanned_pdf")}


# -- filters and lists --------------------------------------------------------


def projected_fields(df: DataFrame, data: str, fields: list[str]) -> DataFrame:
    """The other columns, and one for each field of a JSON column; absent fields are null."""
    rest = [F.col(c) for c in df.columns if c != data]
    return df.select(*rest, *(F.get_json_object(data, f"$.{f}").alias(f) for f in fields))


def active(df: DataFrame) -> DataFrame:
    return df.where("deleted_at IS NULL")


def trash(df: DataFrame) -> DataFrame:
    """Deleted rows, the last deleted first."""
    return df.where("deleted_at IS NOT NULL").orderBy(F.desc("deleted_at"))


def restored(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """All rows; those of `ids` aren't deleted any more."""
    back = ids.select(key).distinct().withColumn("_back", F.lit(True))
    return df.join(back, key, "left").withColumn("deleted_at", F.when(F.col("_back"), None).otherwise(F.col("deleted_at"))).select(*df.columns)


def file_list(files: DataFrame, items: DataFrame, owner: str | None = None, source: str | None = None, job: object = None) -> DataFrame:
    """Files (file_id, owner_id, source, deleted_at) that aren't deleted, of an owner, a source and the items (job_id, file_id) of a job."""
    out = active(files)
    if owner is not None:
        out = out.where(F.col("owner_id") == owner)
    if source is not None:
        out = out.where(F.col("source") == source)
    return out if job is None else out.join(items.where(F.col("job_id") == job), "file_id", "left_semi")


def studies(df: DataFrame, status: str | None, modality: str | None, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of studies with next_offset (null on the last page); both filters come before the page."""
    if status is not None:
        df = df.where(F.col("status") == status)
    if modality is not None:
        df = df.where(F.array_contains("modalities", modality))
    one_more = df.orderBy(*order).offset(offset).limit(limit + 1)
    more = F.count("*").over(Window.partitionBy(F.lit(0))) > limit  # at most limit + 1 rows
    return one_more.withColumn("next_offset", F.when(more, F.lit(offset + limit))).orderBy(*order).limit(limit)


def generic_types(types: DataFrame) -> DataFrame:
    """Enabled types (type_id, enabled, custom, generic, regex) of the default list: generic and not custom."""
    return types.where("enabled AND generic AND NOT custom")


def canonical(type_id: Column) -> Column:
    return F.btrim(F.upper(F.regexp_replace(F.trim(type_id), r"[\s\-]+", "_")), F.lit("_"))


def resolved_types(requested: DataFrame, types: DataFrame) -> DataFrame:
    """(position, type_id): requested ids (position, asked) found exactly, else by their canonical form; disabled ones go, the first of repeated ones stays."""
    known = types.where("enabled").select("type_id")
    exact = known.select(F.col("type_id").alias("exact"))
    loose = known.groupBy(canonical(F.col("type_id")).alias("form")).agg(F.min("type_id").alias("loose"))
    found = requested.join(exact, F.col("asked") == F.col("exact"), "left").join(loose, canonical(F.col("asked")) == F.col("form"), "left")
    return found.withColumn("type_id", F.coalesce("exact", "loose")).where("type_id IS NOT NULL").groupBy("type_id").agg(F.min("position").alias("position"))


def searched(df: DataFrame, words: str, columns: list[str]) -> DataFrame:
    """Rows that have every word of a search somewhere in their columns, without regard to case."""
    text = F.lower(F.concat_ws(" ", *columns))
    out = df
    for word in words.lower().split():
        out = out.where(text.contains(word))
    return out


def severity_rank(severity: Column) -> Column:
    out = F.lit(len(SEVERITIES))
    for i, s in reversed(list(enumerate(SEVERITIES))):
        out = F.when(severity == s, i).otherwise(out)
    return out


def by_severity(risks: DataFrame, *then: str) -> DataFrame:
    return risks.orderBy(severity_rank(F.col("severity")), *then)


def candidates(jobs: DataFrame, states: tuple[str, ...], limit: int) -> DataFrame:
    """The oldest jobs that can be scheduled, between one and MOST_CANDIDATES of them."""
    return jobs.where(F.col("status").isin(*states)).orderBy("created_at", "job_id").limit(max(1, min(limit, MOST_CANDIDATES)))


def review_order(columns: DataFrame) -> DataFrame:
    """Columns of a policy, the riskiest first, then those that change, then by place."""
    return columns.orderBy(severity_rank(F.col("risk")), (F.col("action") == "keep").cast("int"), "place")


def recognition_order(items: DataFrame) -> DataFrame:
    """Items with their place in the job's queue: priority class, work units, sort order."""
    w = Window.partitionBy("job_id").orderBy("priority_class", "work_units", "sort_order")
    return items.withColumn("queue_place", F.row_number().over(w))


# -- joins -------------------------------------------------------------------


def report_rows(items: DataFrame, files: DataFrame) -> DataFrame:
    """Every item with its file's name, kind and size; items without a file keep their id as the name."""
    return items.join(files, "file_id", "left").select(
        *items.columns,
        F.coalesce("name", F.col("file_id").cast("string")).alias("name"),
        F.coalesce("kind", F.lit("unknown")).alias("kind"),
        F.coalesce("size", F.lit(0)).alias("size"),
        F.col("name").isNull().alias("missing"),
    )


def selected_tables(selected: DataFrame, discovered: DataFrame) -> DataFrame:
    """Discovered tables (schema, name, ...) that a selection (schema, table) names; a null schema is one like any other."""
    s = selected.select(F.col("schema").alias("s_schema"), F.col("table").alias("s_table")).distinct()
    return discovered.join(s, F.col("schema").eqNullSafe(F.col("s_schema")) & (F.col("name") == F.col("s_table")), "left_semi")


def risk_instances(risks: DataFrame, instances: DataFrame) -> DataFrame:
    """Risks (path, uid, ...) with instance_id: that of the path, else that of the unique id, else null."""
    by_path = instances.groupBy(F.col("path").alias("i_path")).agg(F.min("instance_id").alias("by_path"))
    by_uid = instances.groupBy(F.col("uid").alias("i_uid")).agg(F.min("instance_id").alias("by_uid"))
    out = risks.join(by_path, F.col("path") == F.col("i_path"), "left").join(by_uid, F.col("uid") == F.col("i_uid"), "left")
    return out.select(*risks.columns, F.coalesce("by_path", "by_uid").alias("instance_id"))


def rescanned_leaks(originals: DataFrame, recognised: DataFrame, normal: Column) -> DataFrame:
    """Originals (doc_id, value) that a second recognition (doc_id, value) finds again, exactly or in `normal` form."""
    found = recognised.select("doc_id", normal.alias("form")).where("form != ''").distinct()
    return originals.withColumn("form", normal).join(found, ["doc_id", "form"], "left_semi").drop("form")


def overridden(defaults: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """All rows of both, a tenant's own values before the default ones, and where each row comes from."""
    names = [c for c in defaults.columns if c != key]
    both = defaults.withColumn("_d", F.lit(1)).alias("d").join(overrides.withColumn("_o", F.lit(1)).alias("o"), key, "full_outer")
    origin = F.when(F.col("o._o").isNull(), "default").when(F.col("d._d").isNull(), "added").otherwise("override")
    return both.select(key, *(F.coalesce(f"o.{c}", f"d.{c}").alias(c) for c in names), origin.alias("origin"))


def reconciled(base: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved types (type_id, name, enabled) brought up to the current ones: names from the base, flags from what was saved; custom types stay, others that no longer exist go."""
    b, s = base.alias("b"), saved.alias("s")
    both = b.join(s, F.col("b.type_id") == F.col("s.type_id"), "full_outer")
    kept = both.where(F.col("b.type_id").isNotNull() | F.col("s.type_id").startswith("custom_"))
    return kept.select(
        F.coalesce("b.type_id", "s.type_id").alias("type_id"), F.coalesce("b.name", "s.name").alias("name"), F.coalesce("s.enabled", "b.enabled").alias("enabled")
    )


def without_disabled(types: DataFrame, disabled: DataFrame) -> DataFrame:
    return types.join(disabled.select("type_id"), "type_id", "left_anti")


def merged_entities(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Recognised entities (doc_id, text, type), and rows of a manual mapping whose text isn't among them."""
    new = mapping.join(entities.select("doc_id", "text").distinct(), ["doc_id", "text"], "left_anti")
    return entities.withColumn("origin", F.lit("recognised")).unionByName(new.withColumn("origin", F.lit("manual")))


def matched_truth(truth: DataFrame, entities: DataFrame, least: int = 2) -> DataFrame:
    """True values (doc_id, value) with the first entity (doc_id, place, text) of the document that has the value in it, or lies in it with `least` characters."""
    t, e = truth.select("doc_id", "value").distinct(), entities.select("doc_id", "place", "text")
    hit = F.col("text").contains(F.col("value")) | ((F.char_length("text") >= least) & F.col("value").contains(F.col("text")))
    first = t.join(e, "doc_id").where(hit).groupBy("doc_id", "value").agg(F.min_by("text", "place").alias("entity"))
    return t.join(first, ["doc_id", "value"], "left")


def dates_outside_numbers(spans: DataFrame, within: tuple[str, ...] = ("CASE_NUMBER", "DOCUMENT_NUMBER")) -> DataFrame:
    """Spans (doc_id, type, start, end) without dates that lie inside a case or document number."""
    n = spans.where(F.col("type").isin(*within)).select(F.col("doc_id").alias("n_doc"), F.col("start").alias("n_start"), F.col("end").alias("n_end"))
    inside = (F.col("doc_id") == F.col("n_doc")) & (F.col("start") >= F.col("n_start")) & (F.col("end") <= F.col("n_end"))
    dates = spans.where("type = 'DATE'").join(n, inside, "left_anti")
    return spans.where("type != 'DATE'").unionByName(dates)


def job_takes(items: DataFrame, rules: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Items (job_type, file_type, ...) with `allowed`; a kind of job without a rule takes all."""
    rules = rules or JOB_FILE_TYPES
    table = F.create_map(*(x for k, v in rules.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return items.withColumn("allowed", F.coalesce(F.array_contains(F.try_element_at(table, F.col("job_type")), F.col("file_type")), F.lit(True)))


# -- figures -----------------------------------------------------------------


def confidence_class(confidence: Column) -> Column:
    return F.when(confidence.isNull(), "unmeasured").when(confidence >= HIGH_CONFIDENCE, "high").when(confidence >= MEDIUM_CONFIDENCE, "medium").otherwise("low")


def redaction_report(entities: DataFrame) -> DataFrame:
    """(dimension, value, n) of entities (type, source, confidence, selected), and the share of selected ones in per cent, to one place."""
    of = {"type": F.col("type"), "source": F.col("source"), "confidence": confidence_class(F.col("confidence"))}
    sides = F.array(*(F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in of.items()))
    counts = entities.select("selected", F.explode(sides).alias("s")).groupBy("s.dimension", "s.value")
    return counts.agg(F.count("*").alias("n"), F.round(F.count_if("selected") * 100.0 / F.count("*"), 1).alias("coverage"))


def visual_evidence(boxes: DataFrame) -> DataFrame:
    """(dimension, value, total, selected) of boxes (source, source_detail, evidence_source, warnings, selected)."""
    one = [F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("source", "source_detail", "evidence_source")]
    warnings = F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.struct(F.lit("warning").alias("dimension"), w.alias("value")))
    rows = boxes.select("selected", F.explode(F.concat(F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *one), warnings)).alias("x"))
    return rows.where("x.value IS NOT NULL").groupBy("x.dimension", "x.value").agg(F.count("*").alias("total"), F.count_if(F.coalesce("selected", F.lit(True))).alias("selected"))


def file_figures(files: DataFrame) -> DataFrame:
    """One row: files, redacted ones, those awaiting review, entities and bytes."""
    return files.agg(
        F.count("*").alias("total"),
        F.count_if("redacted").alias("redacted"),
        F.count_if(~F.col("redacted") & (F.col("entities") > 0)).alias("awaiting_review"),
        F.coalesce(F.sum("entities"), F.lit(0)).alias("entities"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("size"),
    )


def selected_counts(files: DataFrame) -> DataFrame:
    """file_id and how many entities and boxes (arrays of structs with `selected`) are chosen; without both, the size of the map."""
    chosen = lambda c: F.size(F.filter(c, lambda x: ~x["selected"].eqNullSafe(F.lit(False))))
    known = F.coalesce(chosen(F.col("entities")), F.lit(0)) + F.coalesce(chosen(F.col("boxes")), F.lit(0))
    return files.select("file_id", F.when(F.col("entities").isNull() & F.col("boxes").isNull(), F.coalesce(F.size("map"), F.lit(0))).otherwise(known).alias("n_selected"))


def risk_summary(risks: DataFrame) -> DataFrame:
    """(severity, total, open, blocking) of risks, each distinct one once; a risk blocks while it is open and critical or high."""
    once = risks.dropDuplicates(["code", "path", "study", "tag"])
    blocks = (F.col("status") == "open") & F.col("severity").isin("critical", "high")
    return once.groupBy("severity").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "open").alias("open"), F.count_if(blocks).alias("blocking"))


def drop_figures(spans: DataFrame, mapping: DataFrame) -> DataFrame:
    """(label, n, dropped): labels of a corpus that have no type in `mapping` (label, type) are dropped."""
    return spans.groupBy("label").agg(F.count("*").alias("n")).join(mapping, "label", "left").select("label", "n", F.when(F.col("type").isNull(), F.col("n")).otherwise(0).alias("dropped"))


def format_matrix(cells: DataFrame, modes: list[str]) -> DataFrame:
    """A row for each format: how many cells, how many passed, and the share that passed in each mode."""
    passed = lambda cond: F.round(F.avg(F.when(cond, F.col("passed").cast("double"))), 4)
    return cells.groupBy("format").agg(F.count("*").alias("cells"), F.count_if("passed").alias("n_passed"), *(passed(F.col("mode") == m).alias(m) for m in modes))


def coverage_map(entities: DataFrame) -> DataFrame:
    """One row of (doc_id, text): a selected entity before others, then the first by place."""
    best = F.min_by(F.struct("type", "selected", "place"), F.struct((~F.coalesce("selected", F.lit(True))).alias("no"), "place"))
    return entities.groupBy("doc_id", "text").agg(best.alias("b")).select("doc_id", "text", "b.*")


def preview_map(entities: DataFrame) -> DataFrame:
    """(doc_id, original, replacement) of the selected entities, one for each original, the first by place."""
    chosen = entities.where(F.coalesce("selected", F.lit(True)))
    return chosen.groupBy("doc_id", F.col("text").alias("original")).agg(F.min_by("replacement", "place").alias("replacement"))


# -- order and sets ----------------------------------------------------------


def coreference_ids(entities: DataFrame) -> DataFrame:
    """Entities (doc_id, start, coref, text, type) with coref_id: entities of one coref, or one text and type, share it, numbered as they are met."""
    key = F.coalesce("coref", F.concat_ws("|", "text", "type"))
    first = Window.partitionBy("doc_id", key)
    met = Window.partitionBy("doc_id").orderBy("_first", "_key")
    out = entities.withColumn("_key", key).withColumn("_first", F.min("start").over(first))
    return out.withColumn("coref_id", F.concat(F.lit("coref_"), F.dense_rank().over(met))).drop("_key", "_first")


def versions(history: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each file's runs numbered from one."""
    return history.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def ordered_union(parts: list[DataFrame], value: str, order: str) -> DataFrame:
    """Distinct values of several lists, in the order in which they are first met: list by list, then by place."""
    rows = None
    for i, part in enumerate(parts):
        one = part.select(F.col(value).alias(value), F.struct(F.lit(i).alias("list"), F.col(order).cast("long").alias("place")).alias("met"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(value).agg(F.min("met").alias("met")).select(value, "met.list", "met.place")


def missing_types(requested: Column, answered: Column) -> Column:
    """Requested types that an answer (a map from type to values) lacks, in order: those to ask for again."""
    return F.array_except(requested, F.map_keys(answered))


def imported_pools(own: DataFrame, new: DataFrame) -> DataFrame:
    """Word pools (type, words, names): words of both, own ones first; of the names the imported ones win."""
    o, n = own.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.type") == F.col("n.type"), "full_outer")
    no_words = F.array().cast("array<string>")
    no_names = F.create_map().cast("map<string,string>")
    mine, theirs = F.coalesce("o.names", no_names), F.coalesce("n.names", no_names)
    return both.select(
        F.coalesce("o.type", "n.type").alias("type"),
        F.array_union(F.coalesce("o.words", no_words), F.coalesce("n.words", no_words)).alias("words"),
        F.map_concat(F.map_filter(mine, lambda k, _: ~F.map_contains_key(theirs, k)), theirs).alias("names"),
    )


def batch_selection(requested: DataFrame, files: DataFrame) -> DataFrame:
    """Requested files (position, file_id), each once: included with a name that no other has, or skipped with the reason.

    Files at one position stand in order of their ids; a file without a name is called `file`.
    """
    once = requested.groupBy("file_id").agg(F.min("position").alias("position"))
    f = files.select("file_id", F.coalesce(F.col("name"), F.lit("file")).alias("name"), "deleted_at", "has_output", F.lit(True).alias("_there"))
    reason = F.when(F.col("_there").isNull(), "not_found").when(F.col("deleted_at").isNotNull(), "deleted").when(~F.col("has_output"), "no_output")
    out = once.join(f, "file_id", "left").withColumn("reason", reason)
    nth = F.row_number().over(Window.partitionBy("name", F.col("reason").isNull()).orderBy("position", "file_id"))
    named = F.when(nth > 1, F.concat((nth - 1).cast("string"), F.lit("_"), F.col("name"))).otherwise(F.col("name"))
    return out.select("file_id", "position", F.when(F.col("reason").isNull(), named).alias("archive_name"), "reason")


def relocated(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """Entities (doc_id, type, text, start) whose text stands at their offset, or else at its first occurrence; others go."""
    out = entities.join(docs.select("doc_id", F.col("text").alias("_text")), "doc_id")
    here = F.substr("_text", F.col("start").cast("int") + 1, F.char_length("text")) == F.col("text")
    first = F.instr(F.col("_text"), F.col("text")) - 1
    out = out.withColumn("start", F.when(here, F.col("start")).otherwise(first.cast("long"))).where("start >= 0")
    return out.drop("_text").withColumn("end", F.col("start") + F.char_length("text"))


def cell_to_json(column: Column, kind: str) -> Column:
    """A cell as a JSON value: numbers and truth values as they are, decimals as doubles, times in ISO form, all else as text."""
    if kind in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double"):
        return F.to_json(F.struct(column.alias("v")))
    if kind.startswith("decimal"):
        return F.to_json(F.struct(column.cast("double").alias("v")))
    if kind == "date":
        return F.to_json(F.struct(F.date_format(column, "yyyy-MM-dd").alias("v")))
    if kind.startswith("timestamp"):
        return F.to_json(F.struct(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss").alias("v")))
    return F.to_json(F.struct(column.cast("string").alias("v")))
