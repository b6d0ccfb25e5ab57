"""Hashes, routes, names and paths of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import strip

# Limits and names that results depend on.
PAGES, LOW_TEXT, PIPES = 20, 150, 0.005
OFFICE = ["docx", "doc", "odt", "odoc"]
TABULAR = ["abrechnung", "rechnung", "umsatz", "tabelle", "labor", "befund", "eur", "betrag", "gehalt", "lohn"]
UNNAMED = "dokument_searchable"
FORBIDDEN = r'[/*?:"<>|]'


def with_sha(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds sha256 of the content; null when it can't be read (null)."""
    return files.withColumn("sha256", F.sha2(F.col(content), 256))


def text_sha(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def with_route(docs: DataFrame, limit: int = PAGES, reduce_large: bool = True) -> DataFrame:
    """Adds route: office, reduced (more pages than the limit) or detailed."""
    suffix = F.lower(F.regexp_replace("suffix", r"^\.", ""))
    route = F.when(suffix.isin(OFFICE), "office").when((F.col("page_count") > limit) & F.lit(reduce_large), "reduced").otherwise("detailed")
    return docs.withColumn("route", route)


def with_low_text(pages: DataFrame, markdown: str = "docling", ocr: str = "ocr") -> DataFrame:
    """Adds low_text (both channels short) and review (low, but not both empty)."""
    m, o = (F.length(strip(F.coalesce(F.col(c), F.lit("")))) for c in (markdown, ocr))
    return pages.withColumn("low_text", (m < LOW_TEXT) & (o < LOW_TEXT)).withColumn("review", F.col("low_text") & ((m > 0) | (o > 0)))


def with_tabular(docs: DataFrame, name: str, text: str) -> DataFrame:
    """Adds tabular: a telling word in name or text, or many pipes."""
    t = F.coalesce(F.col(text), F.lit(""))
    pipes = (F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))) / F.greatest(F.length(t), F.lit(1))
    return docs.withColumn("tabular", F.lower(F.concat_ws(" ", F.col(name), t)).rlike("|".join(TABULAR)) | (pipes > PIPES))


def with_final_name(meta: DataFrame) -> DataFrame:
    """Adds final_name (date_title_type, or a constant unless there are date and title) and subject (title - type, '' without title).

    Null counts as ''; an empty type leaves its separator.
    """
    date, title, kind = (F.coalesce(F.col(c), F.lit("")) for c in ("date", "title", "document_type"))
    name = F.when((date != "") & (title != ""), F.concat_ws("_", date, title, kind)).otherwise(UNNAMED)
    subject = F.when(title != "", F.concat_ws(" - ", title, kind)).otherwise("")
    return meta.withColumn("final_name", F.regexp_replace(name, FORBIDDEN, "")).withColumn("subject", subject)


def clean_path(c: Column) -> Column:
    """Slashes only; parts trimmed; empty ones and dots dropped."""
    parts = F.transform(F.split(F.translate(F.coalesce(c, F.lit("")), "\\", "/"), "/"), strip)
    return F.array_join(F.filter(parts, lambda p: ~p.isin("", ".", "..")), "/")


def quote_path(c: Column) -> Column:
    """Each part of a cleaned path percent-encoded."""

    def quoted(p: Column) -> Column:
        out = F.url_encode(p)
        for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    return F.array_join(F.transform(F.split(clean_path(c), "/"), quoted), "/")
