"""Job, document and review state as tables: upserts, event logs, duplicates, search, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.joins import joined_to_many
from foliant.functions.text import strip

ERRORS_KEPT, DUPLICATES, PENDING_SHOWN = 3, 5, 200  # fixed values
MANIFEST = "job_manifest_v1"
CATCH_ALL = "Sonstiges"  # fixed value


def latest(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def start_jobs(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of started jobs: created_at stays, every other column is reset; of several starts of a job the last one stands, with the first one's time."""
    began = new.groupBy("job_id").agg(F.min("created_at").alias("_began"))
    new = latest(new, ["job_id"], [F.desc("updated_at"), F.desc("created_at"), F.desc("status")]).join(began, "job_id").withColumn("created_at", F.col("_began")).drop("_began")
    first = jobs.select("job_id", F.col("created_at").alias("_first"))
    started = new.join(first, "job_id", "left").withColumn("created_at", F.coalesce("_first", "created_at")).drop("_first")
    return jobs.join(new.select("job_id"), "job_id", "left_anti").unionByName(started.select(jobs.columns))


def start_events(new: DataFrame) -> DataFrame:
    """The event that each start leaves: job_id, event, stage, status, payload_json (source_path, source_sha256), created_at."""
    payload = F.to_json(F.struct("source_path", "source_sha256"), {"ignoreNullFields": "false"})
    return new.select("job_id", F.lit("started").alias("event"), F.lit("").alias("stage"), F.lit("started").alias("status"), payload.alias("payload_json"), F.col("updated_at").alias("created_at"))


def update_events(updates: DataFrame) -> DataFrame:
    """The event that each update leaves, with the columns that it sets (those that aren't null) as payload."""
    given = [c for c in updates.columns if c not in ("job_id", "status", "updated_at")]
    payload = F.to_json(F.struct(*given)) if given else F.lit("{}")
    return updates.select("job_id", F.lit("status").alias("event"), F.lit("").alias("stage"), "status", payload.alias("payload_json"), F.col("updated_at").alias("created_at"))


def update_jobs(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """updates (job_id, status, any of five columns, updated_at): status always, the others where they aren't null.

    Several updates of a job count one after another, in the order of updated_at.
    """
    allowed = [c for c in ("source_sha256", "final_name", "target_path", "metadata_json", "error") if c in updates.columns]
    order = F.struct("updated_at", "status")
    u = updates.groupBy("job_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"_{c}") for c in ["status", "updated_at", *allowed]])
    both = jobs.join(u, "job_id", "left")
    return both.withColumns({c: F.coalesce(f"_{c}", c) for c in ["status", "updated_at", *allowed]}).select(jobs.columns)


def record_events(events: DataFrame, payload: list[str]) -> DataFrame:
    """Event rows ready to append: payload columns as one JSON text."""
    return events.withColumn("payload_json", F.to_json(F.struct(*payload))).drop(*payload)


def job_state(events: DataFrame) -> DataFrame:
    """events (job_id, event_id, event, value, created_at) -> the latest of each job, its size and span."""
    last = F.max_by(F.struct("event", "value"), F.struct("created_at", "event_id"))
    got = events.groupBy("job_id").agg(last.alias("last"), F.count("*").alias("events"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    return got.select("job_id", F.col("last.event").alias("status"), F.col("last.value").alias("value"), "events", "first_at", "last_at")


def find_duplicates(docs: DataFrame, index: DataFrame, n: int = DUPLICATES) -> DataFrame:
    """docs (doc_id, sha256), index (id, source_sha256, updated_at) -> doc_id, id, place: the most recent equal entries.

    The index is cut to n + 1 entries a hash before the join (one may be the document itself), so a hot hash
    joins with a bounded number, and the documents of one hash are dealt to several places.
    """
    recent = latest(index.filter("source_sha256 is not null"), ["source_sha256"], [F.desc("updated_at"), F.desc("id")], n + 1)
    hits = joined_to_many(docs.select("doc_id", "sha256").filter("sha256 is not null"), recent.withColumnRenamed("source_sha256", "sha256"), ["sha256"]).filter("doc_id <> id")
    w = Window.partitionBy("doc_id").orderBy(F.desc("updated_at"), F.desc("id"))
    return hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("doc_id", "id", "place")


def index_documents(done: DataFrame) -> DataFrame:
    """Rows to append to the document index: one for each finished document, none for deferred ones."""
    return done.filter("status <> 'deferred'").select("source_sha256", "source_name", "final_name", "target_path", F.col("finished_at").alias("created_at"), F.col("finished_at").alias("updated_at"))


def search(index: DataFrame, query: str, n: int, columns: list[str], order: list[Column]) -> DataFrame:
    """Newest rows with the query in any of the columns (case-blind; % and _ are wildcards); all rows if it is empty."""
    found = F.lit(query == "")
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike("%" + query.replace("\\", "\\\\") + "%"), F.lit(False))  # a backslash is a letter
    return index.filter(found).orderBy(*order).limit(n)


def review_add(queue: DataFrame, items: DataFrame) -> DataFrame:
    return queue.unionByName(items.withColumn("status", F.lit("pending")).withColumn("resolved_at", F.lit(None).cast("timestamp")).select(queue.columns))


def review_resolve(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions (id, status, chosen_path, resolved_at); rows without an id change nothing, the last one of an id counts."""
    d = latest(decisions.filter("id is not null"), ["id"], [F.desc("resolved_at"), F.desc("chosen_path"), F.desc("status")]).select("id", *[F.col(c).alias(f"_{c}") for c in ("status", "chosen_path", "resolved_at")])
    return queue.join(d, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("status", "chosen_path", "resolved_at")}).select(queue.columns)


def review_list(queue: DataFrame, status: str, n: int) -> DataFrame:
    return queue.filter(F.col("status") == status).orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def dashboard(files: DataFrame, dirs: DataFrame, queue: DataFrame, paths: DataFrame) -> DataFrame:
    """One row: files_waiting, active_dirs, pending_reviews (at most PENDING_SHOWN), known_paths."""
    counts = [
        files.agg(F.count("*").alias("files_waiting")), dirs.filter("active").agg(F.count("*").alias("active_dirs")),
        queue.filter("status = 'pending'").agg(F.least(F.count("*"), F.lit(PENDING_SHOWN)).alias("pending_reviews")), paths.agg(F.count("*").alias("known_paths")),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(F.broadcast(c))  # one row each
    return out


def stage_report(events: DataFrame) -> DataFrame:
    """events (job_id, stage, status, started_at, ended_at, warning, event_id) -> the last record of each stage with duration_ms, and all its warnings."""
    us = F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    ms = F.floor((us + 5) / 10) / 100
    last = F.max_by(F.struct("status", ms.alias("duration_ms")), F.struct("ended_at", "event_id"))
    warnings = F.array_sort(F.collect_list("warning"))
    got = events.groupBy("job_id", "stage").agg(last.alias("last"), warnings.alias("warnings"))
    return got.select("job_id", "stage", F.col("last.status").alias("status"), F.col("last.duration_ms").alias("duration_ms"), "warnings")


def manifests(stages: DataFrame, outputs: DataFrame, sources: DataFrame, uploads: DataFrame) -> DataFrame:
    """job_id, manifest: what is known of a job as JSON, with its source, stages by name, outputs, uploads and all warnings.

    stages (job_id, stage, status, duration_ms, warnings), outputs (job_id, kind, path), sources (job_id,
    original_path, sha256), uploads (job_id, target, name).
    """
    listed = F.array_sort(F.collect_list(F.struct("stage", F.struct("status", "duration_ms", "warnings").alias("v"))))
    s = stages.groupBy("job_id").agg(listed.alias("all"))
    s = s.select("job_id", F.map_from_entries("all").alias("stages"), F.flatten(F.transform("all", lambda x: x["v"]["warnings"])).alias("warnings"))
    o = outputs.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "path")))).alias("outputs"))
    name = F.element_at(F.split("original_path", "/"), -1)
    source = F.struct("original_path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("suffix"), "sha256")
    u = uploads.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("target", "name"))).alias("uploads"))
    rows = s.join(o, "job_id", "left").join(sources.select("job_id", source.alias("source")), "job_id", "left").join(u, "job_id", "left")
    sent = F.coalesce("uploads", F.array().cast("array<struct<target:string,name:string>>")).alias("uploads")
    record = F.struct(F.lit(MANIFEST).alias("schema"), "job_id", "source", "outputs", "stages", sent, "warnings")
    return rows.select("job_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("manifest"))


def artifact_stats(outputs: DataFrame, files: DataFrame) -> DataFrame:
    """outputs (doc_id, path), files (path, size, sha256) -> adds exists, size, sha256."""
    return outputs.join(files.select("path", "size", "sha256", F.lit(True).alias("_there")), "path", "left").withColumn("exists", F.coalesce("_there", F.lit(False))).drop("_there")


def defer(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents for known paths, and those that wait for a decision on a new path."""
    return results.filter("not is_new"), results.filter("is_new")


def release(pending: DataFrame, decisions: DataFrame, known: DataFrame, persons: DataFrame) -> DataFrame:
    """Waiting documents that are freed, with all their columns, their final path, proposed_path and status.

    pending (doc_id, path, ...), decisions (path, final_path, decided_at: the last one of a path counts), known (path), persons
    (name, ord). A path that has become known meanwhile needs no decision and stays as it is. Every final path is cleaned, and
    its main folder is a person in the known spelling, else the catch-all.
    """
    d = latest(decisions, ["path"], [F.desc("decided_at"), F.desc("final_path")]).select("path", F.coalesce("final_path", "path").alias("_final"))
    there = known.select("path").distinct().withColumn("_there", F.lit(True))
    proposed = pending.select("path").distinct().join(d, "path", "left").join(there, "path", "left").filter("_final is not null or _there")
    parts = F.filter(F.transform(F.split(F.translate(F.when(F.col("_there"), F.col("path")).otherwise(F.col("_final")), "\\", "/"), "/"), strip), lambda p: p != "")
    people = persons.groupBy(F.lower("name").alias("_lower")).agg(F.min_by("name", "ord").alias("_name"))
    named = proposed.withColumn("_parts", parts).withColumn("_lower", F.lower(F.get("_parts", F.lit(0)))).join(people, "_lower", "left")
    final = F.array_join(F.concat(F.array(F.coalesce("_name", F.lit(CATCH_ALL))), F.slice("_parts", F.lit(2), F.greatest(F.size("_parts") - 1, F.lit(0)))), "/")
    paths = named.select("path", final.alias("_path"))
    return pending.join(paths, "path").withColumn("proposed_path", F.col("path")).withColumn("path", F.col("_path")).withColumn("status", F.lit("completed")).drop("_path")


def resolve_artifacts(outputs: DataFrame, moves: DataFrame, files: DataFrame) -> DataFrame:
    """outputs (doc_id, path), moves (doc_id, moved_path) -> doc_id, path, found: where it is now, null if nowhere."""
    name = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    here = files.select("path", F.lit(True).alias("_here"))
    moved = moves.join(files.select(F.col("path").alias("moved_path")), "moved_path", "left_semi").withColumn("_name", name(F.col("moved_path")))
    out = outputs.join(here, "path", "left").withColumn("_name", name(F.col("path"))).join(moved, ["doc_id", "_name"], "left")
    return out.groupBy("doc_id", "path").agg(F.coalesce(F.max(F.when(F.col("_here"), F.col("path"))), F.min("moved_path")).alias("found"))


def runtime_audit(jobs: DataFrame, options: DataFrame, prompt: str) -> DataFrame:
    """Each job with the run's options and the prompt's hash and length; options that aren't one row raise an error."""
    c = F.coalesce(F.col(prompt), F.lit(""))
    one = options.agg(F.collect_list(F.struct(*options.columns)).alias("_o"))
    checked = F.when(F.size("_o") != 1, F.raise_error(F.lit("a run has one row of options"))).otherwise(F.get("_o", F.lit(0)))
    return jobs.join(F.broadcast(one.select(checked.alias("_o")).select("_o.*"))).withColumns({"prompt_sha256": F.sha2(c, 256), "prompt_chars": F.length(c)}).drop(prompt)
