"""Reading folders, registries, histories and pointer files; plans and sinks for what documents leave behind."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import strip

# What is read, what is skipped, what each format writes.
SUFFIXES = ["pdf", "png", "jpg", "jpeg", "docx", "doc", "odt", "odoc", "heic"]
UNFINISHED = r"\.(tmp|part|crdownload|download)"
FORMATS = {"Nur PDF": ["pdf"], "Nur TXT": ["txt"], "PDF und TXT": ["pdf", "txt"], "Nur DOCX": ["docx"], "PDF und DOCX": ["pdf", "docx"]}
COMPANIONS, REPORT = "begleitdateien/", "_quality_report.json"
POINTER, POINTER_PLAIN = "Synology Office Dokument-Link", "Synology .odoc Inhalt:\n"
ARCHIVED = ["pdf", "txt", "docx", "odt", "doc", "odoc"]
HISTORY = T.StructType([T.StructField(c, T.StringType()) for c in ("job_id", "event", "status", "detail")] + [T.StructField("timestamp_utc", T.TimestampType())])
CONTEXT = "struct<object_type:string,aliases:array<string>,keywords:array<string>,notes:string>"
REGISTRY = f"persons array<string>, known_paths array<string>, drive_folders map<string,string>, path_contexts map<string,{CONTEXT}>"


DECISION = "struct<timestamp_utc:string,proposed_path:string,chosen_path:string,accepted:boolean>"
COUNTERS = "struct<confirmed_count:int,last_confirmed_at:string,positive_terms:map<string,int>,negative_terms:map<string,int>,document_types:map<string,int>>"
MEMORY = f"decisions array<{DECISION}>, path_stats map<string,{COUNTERS}>"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. One of our own only in local runs that set none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def accepted(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(SUFFIXES) & ~F.lower(name).rlike(UNFINISHED)


def scan_inputs(spark: SparkSession, dirs: list[str]) -> DataFrame:
    """path, name, size, modified of the accepted files in the folders; contents are not read."""
    files = spark.read.format("binaryFile").load(dirs).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.filter(accepted(F.col("name")))


def resolved(path: Column, base: str) -> Column:
    """An absolute path: one that is relative lies below the base; ``.``, ``..`` and empty parts are worked off."""
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))
    parts = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def dedupe_dirs(dirs: DataFrame, base: str | None = None) -> DataFrame:
    """dirs (dir, ord): without null and empty ones, resolved below the base if one is given; the first of those that differ in case alone."""
    dirs = dirs.filter("coalesce(dir, '') <> ''")
    if base is not None:
        dirs = dirs.withColumn("dir", resolved(F.col("dir"), base))
    w = Window.partitionBy(F.lower("dir")).orderBy("ord")
    return dirs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def exclude_reserved(dirs: DataFrame, reserved: DataFrame, base: str) -> DataFrame:
    """Without the base itself and what lies in a reserved folder: a folder's own ancestors are looked up."""
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda i: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), i), "/"))
    inside = dirs.select("dir", F.explode(up).alias("path")).join(reserved.select("path"), "path", "left_semi").select("dir").distinct()
    return dirs.filter(F.col("dir") != base).join(inside, "dir", "left_anti")


def with_source_profile(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """Adds profile: that of the input folder a file lies in, else manual; of a folder listed twice the first (by ord, if there is one)."""
    order = F.col("ord") if "ord" in dirs.columns else F.col("profile")
    known = dirs.groupBy("dir").agg(F.min_by("profile", order).alias("_p"))
    return files.withColumn("dir", F.regexp_replace("path", "/[^/]*$", "")).join(known, "dir", "left").withColumn("profile", F.coalesce("_p", F.lit("manual"))).drop("_p", "dir")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).json(path)


def append_history(rows: DataFrame, path: str) -> None:
    """Appends JSON lines; rows without a time get the present one."""
    rows.withColumn("timestamp_utc", F.coalesce("timestamp_utc", F.current_timestamp())).write.mode("append").json(path)


def load_registry(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A registry file as tables person, path, folder_map and path_context; missing keys are empty."""
    one = spark.read.option("multiLine", True).schema(REGISTRY).json(path)
    context = one.select(F.explode("path_contexts").alias("path", "c")).select("path", "c.*")
    return {
        "person": one.select(F.posexplode("persons").alias("ord", "name")), "path": one.select(F.posexplode("known_paths").alias("ord", "path")),
        "folder_map": one.select(F.explode("drive_folders").alias("path", "folder_id")), "path_context": context,
    }


def load_memory(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A memory file as tables decision, path_term (path, kind, term, n) and path_stat; missing keys are empty."""
    one = spark.read.option("multiLine", True).schema(MEMORY).json(path)
    stats = one.select(F.explode("path_stats").alias("path", "s")).select("path", "s.*")
    kinds = {"positive": "positive_terms", "negative": "negative_terms", "type": "document_types"}
    terms = [stats.select("path", F.lit(k).alias("kind"), F.explode(c).alias("term", "n")) for k, c in kinds.items()]
    return {
        "decision": one.select(F.explode("decisions").alias("d")).select("d.*"), "path_term": terms[0].union(terms[1]).union(terms[2]),
        "path_stat": stats.select("path", F.coalesce("confirmed_count", F.lit(0)).alias("confirmed_count"), "last_confirmed_at"),
    }


def pointer_text(df: DataFrame, text: str = "text", stem: str = "stem") -> DataFrame:
    """JSON pointer documents as a heading and title, url and id lines; anything else as plain text under its label.

    A missing title is the file's stem; a missing or empty url or id gives no line; null counts as empty text.
    """
    c = strip(F.coalesce(F.col(text), F.lit("")))
    p = F.from_json(c, "title string, url string, doc_id string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    more = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in (("URL", p["url"]), ("Dokument-ID", p["doc_id"]))]
    shown = F.concat_ws("\n", F.lit(POINTER), F.concat(F.lit("Titel: "), F.coalesce(p["title"], F.col(stem), F.lit(""))), *more)
    good = c.startswith("{") & p.isNotNull() & p["_bad"].isNull()
    return df.withColumn(text, F.when(good, shown).otherwise(F.concat(F.lit(POINTER_PLAIN), F.coalesce(F.col(text), F.lit("")))))


def plan_exports(docs: DataFrame, fmt: str, save_docx: bool = True, save_report: bool = True, upload_docx: bool = False, upload_report: bool = False) -> DataFrame:
    """docs (doc_id, final_name, office) -> doc_id, kind, file_name: what each document is exported as.

    An office document gives a docx and no pdf; others give a docx where the format asks for it and it is saved, or
    where it is uploaded, and that one lies in the companions' folder, like the quality report.
    """
    kinds = FORMATS[fmt]
    plain = [k for k in kinds if k != "docx"] + ["companion"] * (("docx" in kinds and save_docx) or upload_docx)
    office = ["docx", *[k for k in kinds if k == "txt"]]
    report = ["report"] * (save_report or upload_report)
    listed = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    rows = docs.select("doc_id", "final_name", F.explode(F.when(F.col("office"), listed(office + report)).otherwise(listed(plain + report))).alias("kind"))
    beside = F.concat(F.lit(COMPANIONS), F.col("final_name"))
    name = F.when(F.col("kind") == "report", F.concat(beside, F.lit(REPORT))).when(F.col("kind") == "companion", F.concat(beside, F.lit(".docx"))).otherwise(F.concat_ws(".", "final_name", "kind"))
    return rows.select("doc_id", F.when(F.col("kind") == "companion", "docx").otherwise(F.col("kind")).alias("kind"), name.alias("file_name"))


def write_text(df: DataFrame, path: str) -> None:
    """doc_id, target_path, text as Parquet by target path: a document's text at a place is replaced, all others stay.

    Of several texts of a document for one place the greatest is written. See ``ledger.merge_write``.
    """
    from foliant.sources import ledger

    one = df.groupBy("doc_id", "target_path").agg(F.max("text").alias("text"))
    ledger.merge_write(one.select("doc_id", "text", "target_path"), path, "target_path", ["doc_id"])


def write_reports(df: DataFrame, path: str) -> None:
    """A row's columns as one JSON line, nulls included."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def write_manifests(records: DataFrame, path: str) -> None:
    """Appends job_id, record (JSON), written_at; a job's later record stands for it (see ``read_manifests``)."""
    records.select("job_id", "record", F.current_timestamp().alias("written_at")).write.mode("append").parquet(path)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """job_id, record: the latest of each job, of equal times the greater one."""
    last = F.max_by("record", F.struct("written_at", "record")).alias("record")
    return spark.read.parquet(path).groupBy("job_id").agg(last)


def archived(artifacts: DataFrame) -> DataFrame:
    """artifacts (path, target_path, content) -> those that are archived, with the cleaned target_path and file_name."""
    name = F.element_at(F.split("path", "/"), -1)
    target = F.translate(strip(F.coalesce("target_path", F.lit(""))), "\\", "/")
    rows = artifacts.select("path", target.alias("target_path"), name.alias("file_name"), "content")
    return rows.filter(F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1)).isin(ARCHIVED))


def write_archive(artifacts: DataFrame, path: str) -> None:
    """Every archived artifact under its target path (target_path=.../): a file of the same place and name is replaced, all others stay.

    Of several artifacts of one name for one place that of the greatest path is written. See ``ledger.merge_write``.
    """
    from foliant.sources import ledger

    w = Window.partitionBy("target_path", "file_name").orderBy(F.desc("path"))
    last = archived(artifacts).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("file_name", "content", "target_path")
    ledger.merge_write(last, path, "target_path", ["file_name"])


def retain_latest(rows: DataFrame, n: int = 3) -> DataFrame:
    """The n rows with the latest modified time."""
    return rows.orderBy(F.desc("modified"), "path").limit(n)


def cleanup_plan(artifacts: DataFrame, save_docx: bool, save_report: bool) -> DataFrame:
    """artifacts (doc_id, path, kind, deferred) -> path, action: a docx or report that isn't saved locally was made for the upload and goes afterwards, unless its document is deferred."""
    gone = ((F.col("kind") == "docx") & F.lit(not save_docx) | (F.col("kind") == "report") & F.lit(not save_report)) & ~F.col("deferred")
    return artifacts.select("doc_id", "path", F.when(gone, "delete").otherwise("keep").alias("action"))
