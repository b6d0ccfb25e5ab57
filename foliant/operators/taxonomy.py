"""Folder taxonomy (paths, persons, contexts) and the planning of synchronised folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import strip

# Template folders and forbidden names.
TEMPLATE = ["Gesundheit", "Finanzen", "Versicherungen", "Steuern", "Arbeit", "Schule", "Wohnen", "Auto", "Verträge", "Sonstiges"]
RESERVED = "(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"


def parts_of(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.translate(strip(F.coalesce(c, F.lit(""))), "\\", "/"), "/"), strip), lambda p: p != "")


def add_paths(requests: DataFrame, paths: DataFrame, persons: DataFrame) -> DataFrame:
    """requests (ord, path) -> ord, path, outcome: added, empty, unknown_person or duplicate; the first of equal ones is added."""
    people = persons.select(F.lower("name").alias("_lower"), F.col("name").alias("_name"))
    r = requests.withColumn("_parts", parts_of(F.col("path"))).withColumn("_lower", F.lower(F.get("_parts", F.lit(0)))).join(people, "_lower", "left")
    r = r.withColumn("path", F.when(F.size("_parts") == 0, "").otherwise(F.array_join(F.concat(F.array(F.coalesce("_name", F.get("_parts", F.lit(0)))), F.slice("_parts", F.lit(2), F.greatest(F.size("_parts") - 1, F.lit(0)))), "/")))
    r = r.join(paths.select("path", F.lit(True).alias("_known")), "path", "left")
    again = F.row_number().over(Window.partitionBy("path").orderBy("ord")) > 1
    outcome = F.when(F.size("_parts") == 0, "empty").when(F.col("_name").isNull(), "unknown_person").when(F.col("_known") | again, "duplicate").otherwise("added")
    return r.select("ord", "path", outcome.alias("outcome"))


def path_closure(paths: DataFrame) -> DataFrame:
    """Every path and all above it, once: path, depth."""
    parts = parts_of(F.col("path"))
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), i.alias("depth")))
    return paths.filter(F.size(parts) > 0).select(F.explode(up).alias("p")).select("p.*").distinct()


def paths_at_depth(paths: DataFrame, depth: int) -> DataFrame:
    return path_closure(paths).filter(F.col("depth") == depth).select("path")


def children(paths: DataFrame) -> DataFrame:
    """parent, children (sorted names): the listing of each folder that has any."""
    c = path_closure(paths).filter("depth > 1")
    parent = F.regexp_replace("path", "/[^/]*$", "")
    return c.groupBy(parent.alias("parent")).agg(F.array_sort(F.collect_list(F.element_at(F.split("path", "/"), -1))).alias("children"))


def clean_terms(c: Column) -> Column:
    """Terms between commas or line ends, spaces collapsed, the first of those that differ in case alone."""
    terms = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,\n]"), lambda t: strip(F.regexp_replace(t, r"(?U)\s+", " "))), lambda t: t != "")
    keys = F.transform(terms, lambda t: F.replace(F.lower(t), F.lit("ß"), F.lit("ss")))
    return F.filter(terms, lambda t, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def prune(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of known paths only."""
    return rows.join(paths.select("path"), "path", "left_semi")


def prune_contexts(contexts: DataFrame, paths: DataFrame) -> DataFrame:
    """Contexts of known paths that say anything."""
    told = (F.coalesce("object_type", F.lit("")) != "") | (F.size(F.coalesce("aliases", F.array())) > 0) | (F.size(F.coalesce("keywords", F.array())) > 0) | (F.coalesce("notes", F.lit("")) != "")
    return prune(contexts, paths).filter(told)


def rename_prefix(rows: DataFrame, old: str, new: str) -> DataFrame:
    """The path and all below it move; others stay."""
    inside = (F.col("path") == old) | F.startswith("path", F.lit(old + "/"))
    return rows.withColumn("path", F.when(inside, F.concat(F.lit(new), F.substring("path", len(old) + 1, 1 << 30))).otherwise(F.col("path")))


def rename_clashes(paths: DataFrame, renames: DataFrame) -> DataFrame:
    """renames (old, new) -> adds clash: another folder has the new path, in any case of letters."""
    known = path_closure(paths).select(F.lower("path").alias("_lower"), F.col("path").alias("_path"))
    hit = renames.withColumn("_lower", F.lower("new")).join(known, "_lower", "left")
    return hit.groupBy("old", "new").agg(F.coalesce(F.max(F.col("_path") != F.col("old")), F.lit(False)).alias("clash"))


def tidy_name(c: Column) -> Column:
    return F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?U)\s+", " ")


def apply_template(persons: DataFrame, paths: DataFrame) -> DataFrame:
    """persons (name) -> path: the persons' own folders and the template's below them, as far as they lack in any case of letters.

    Names are tidied, then those that break a rule are left out (see ``rejected_names``); a known folder keeps its spelling.
    """
    have = path_closure(paths).withColumn("_lower", F.lower("path"))
    good = validate_names(persons.select(tidy_name(F.col("name")).alias("name"))).filter("problem is null")
    good = good.groupBy(F.lower("name").alias("_lower")).agg(F.min("name").alias("name"))
    roots = have.filter("depth = 1").groupBy("_lower").agg(F.min("path").alias("_known"))
    keyed = good.join(roots, "_lower", "left").select(F.coalesce("_known", "name").alias("name"))
    want = keyed.select(F.explode(F.concat(F.array("name"), F.transform(F.array(*map(F.lit, TEMPLATE)), lambda f: F.concat_ws("/", F.col("name"), f)))).alias("path"))
    return want.withColumn("_lower", F.lower("path")).join(have.select("_lower"), "_lower", "left_anti").select("path")


def rejected_names(persons: DataFrame) -> DataFrame:
    """persons (name) -> name, problem: those that get no template."""
    return validate_names(persons.select(F.col("name").alias("raw"), tidy_name(F.col("name")).alias("name"))).filter("problem is not null").select(F.col("raw").alias("name"), "problem")


def validate_names(names: DataFrame) -> DataFrame:
    """Adds problem: the first rule that a folder name breaks; null if none."""
    c = F.coalesce("name", F.lit(""))
    tidy = F.regexp_replace(strip(c), r"(?U)\s+", " ")
    problem = F.when(c != strip(c), "outer_space").when(tidy == "", "empty").when((tidy != c) | tidy.endswith("."), "inner_space_or_dot")
    problem = problem.when(c.rlike(r"[\x00-\x1F]"), "control").when(c.rlike(r'[<>:"/\\|?*]'), "forbidden").when(c.rlike(RESERVED), "reserved")
    return names.withColumn("problem", problem)


def move_plan(pending: DataFrame, dirs: DataFrame) -> DataFrame:
    """pending (old, new), dirs (path) -> old, new, action (same, missing, conflict, move), depth of the old folder: parents have the smaller one."""
    have = dirs.select("path")
    p = pending.join(have.select(F.col("path").alias("old"), F.lit(True).alias("_old")), "old", "left").join(have.select(F.col("path").alias("new"), F.lit(True).alias("_new")), "new", "left")
    action = F.when(F.col("old") == F.col("new"), "same").when(F.col("_old").isNull(), "missing").when(F.col("_new"), "conflict").otherwise("move")
    return p.select("old", "new", action.alias("action"), F.size(F.split("old", "/")).alias("depth"))


def sync_preview(paths: DataFrame, folder_map: DataFrame) -> DataFrame:
    """One row: total, mapped, missing."""
    ids = folder_map.filter("coalesce(folder_id, '') <> ''").select("path", F.lit(1).alias("_id")).distinct()
    return paths.join(ids, "path", "left").agg(F.count("*").alias("total"), F.count("_id").alias("mapped"), F.sum(F.col("_id").isNull().cast("long")).alias("missing"))


def folder_plan(paths: DataFrame, folder_map: DataFrame, remote: DataFrame) -> DataFrame:
    """path, depth, action (trusted, found, create), folder_id, conflict: every folder that synchronising needs.

    remote (path, entry_id, trashed): of several folders with one path the smallest id is used, as a conflict.
    """
    there = remote.filter("not trashed").groupBy("path").agg(F.min("entry_id").alias("_found"), (F.count("*") > 1).alias("_many"))
    out = path_closure(paths).join(folder_map.select("path", F.col("folder_id").alias("_id")), "path", "left").join(there, "path", "left")
    action = F.when(F.coalesce("_id", F.lit("")) != "", "trusted").when(F.col("_found").isNotNull(), "found").otherwise("create")
    conflict = (action == "found") & F.coalesce("_many", F.lit(False))
    return out.select("path", "depth", action.alias("action"), F.when(action == "trusted", F.col("_id")).otherwise(F.col("_found")).alias("folder_id"), conflict.alias("conflict"))


def upload_plan(artifacts: DataFrame, remote: DataFrame, chosen: list[str]) -> DataFrame:
    """artifacts (doc_id, folder, name, kind, office), remote (folder, name, entry_id) -> doc_id, folder, name, action, entry_id.

    Office documents always send docx and never pdf.
    """
    wanted = F.when(F.col("office"), (F.col("kind") == "docx") | (F.col("kind").isin(chosen) & (F.col("kind") != "pdf"))).otherwise(F.col("kind").isin(chosen))
    there = remote.groupBy("folder", "name").agg(F.min("entry_id").alias("entry_id"))
    return artifacts.filter(wanted).join(there, ["folder", "name"], "left").select("doc_id", "folder", "name", F.when(F.col("entry_id").isNull(), "create").otherwise("update").alias("action"), "entry_id")
