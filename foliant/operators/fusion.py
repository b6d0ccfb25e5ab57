"""Assembly and fusion of the text channels of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import blank, strip

# Channels from the most to the least trusted, limits.
CHANNELS = ("vision", "glm", "docling", "ocr")
CONTEXT, ACCEPTED = 4000, 0.7  # letters of the previous page; share of a text that its correction exceeds
MARKDOWN_SENT, OCR_SENT = 8000, 6000
SECTIONS = {
    "previous": "--- KONTEXT VORHERIGE SEITE (nur für Seitenübergänge!) ---\n",
    "markdown": "--- Vision-Review Markdown (Hauptquelle) ---\n",
    "glm": "--- GLM-OCR Text (strukturierte Rohextraktion) ---\n",
    "ocr": "--- OCR Rohtext / Sidecar (Absicherung) ---\n",
}
IMAGE, IMAGE_ON_PAGE = "[Bildbeschreibung: %s]", "[Bildbeschreibung Seite %d: %s]"
GAP = "\n\n"


def joined(order: list[str], text: str, sep: str = GAP) -> Column:
    """Aggregate: texts of a group in order, with ``sep`` between."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda x: x["_t"]), sep)


def chunks_to_pages(chunks: DataFrame) -> DataFrame:
    """chunks (doc_id, chunk_no, text, pages) -> doc_id, page_num, text: a chunk counts on each page it names, else on page 1."""
    pages = F.when(F.coalesce(F.size("pages"), F.lit(0)) <= 0, F.array(F.lit(1))).otherwise(F.array_distinct("pages"))
    return chunks.select("doc_id", "chunk_no", "text", F.explode(pages).alias("page_num")).groupBy("doc_id", "page_num").agg(joined(["chunk_no"], "text").alias("text"))


def pivot_channels(page_text: DataFrame) -> DataFrame:
    """Long form -> one row a page with a column per channel, '' where missing."""
    wide = page_text.groupBy("doc_id", "page_num").pivot("channel", list(CHANNELS)).agg(F.first("text"))
    return wide.na.fill("", list(CHANNELS))


def best_source(df: DataFrame) -> DataFrame:
    """Adds best and best_source: the first channel with a text that isn't blank ('' and null if none)."""
    text = F.coalesce(*[F.when(~blank(F.col(c)), F.col(c)) for c in CHANNELS], F.lit(""))
    name = F.coalesce(*[F.when(~blank(F.col(c)), F.lit(c)) for c in CHANNELS])
    return df.withColumn("best", text).withColumn("best_source", name)


def fuse_pages(df: DataFrame, model: str = "model") -> DataFrame:
    """Adds fused, source and status: the model's text, else the best channel, else ''."""
    out = best_source(df)
    none, silent = F.col("best_source").isNull(), blank(F.col(model))
    fused = F.when(none, "").when(silent, F.col("best")).otherwise(F.col(model))
    status = F.when(none, "skipped").when(silent, "degraded").otherwise("ok")
    return out.withColumn("fused", fused).withColumn("source", F.when(~none & ~silent, "model").otherwise(F.col("best_source"))).withColumn("status", status).drop("best", "best_source")


def stage_status(pages: DataFrame) -> DataFrame:
    """ok if any page of the document has text, else degraded."""
    return pages.groupBy("doc_id").agg(F.when(F.max((~blank(F.col("fused"))).cast("int")) == 1, "ok").otherwise("degraded").alias("status"))


def with_prev_page(pages: DataFrame, text: str = "fused") -> DataFrame:
    """Adds prev_context: the first letters of the page right before this one, '' if there is none."""
    w = Window.partitionBy("doc_id").orderBy("page_num")
    prev = F.when(F.lag("page_num").over(w) == F.col("page_num") - 1, F.lag(text).over(w))
    return pages.withColumn("prev_context", F.coalesce(F.substring(prev, 1, CONTEXT), F.lit("")))


def fusion_prompt(df: DataFrame) -> DataFrame:
    """Adds prompt: previous page, Markdown, glm and ocr, each under its label; the first and third only if not empty.

    The Markdown is the vision text where the page has one, even an empty one, and else docling's.
    """

    def section(name: str, c: Column, most: int) -> Column:
        return F.concat(F.lit(SECTIONS[name]), F.substring(c, 1, most))

    prev, glm = (F.coalesce(F.col(c), F.lit("")) for c in ("prev_context", "glm"))
    markdown, ocr = F.coalesce("vision", "docling", F.lit("")), F.coalesce("ocr", F.lit(""))
    parts = [F.when(prev != "", section("previous", prev, CONTEXT)), section("markdown", markdown, MARKDOWN_SENT), F.when(glm != "", section("glm", glm, OCR_SENT)), section("ocr", ocr, OCR_SENT)]
    return df.withColumn("prompt", F.concat_ws(GAP, *parts))


def doc_text(pages: DataFrame, text: str = "fused", docs: DataFrame | None = None) -> DataFrame:
    """doc_id, text: pages in order with a blank line between, empty pages included.

    docs (doc_id, ocr_text): documents without a page give their ocr text.
    """
    out = pages.groupBy("doc_id").agg(joined(["page_num"], text).alias("text"))
    if docs is None:
        return out
    return docs.select("doc_id", "ocr_text").join(out, "doc_id", "left").select("doc_id", F.coalesce("text", "ocr_text", F.lit("")).alias("text"))


def inject_descriptions(pages: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Puts an image description (doc_id, page_num, description) in front of its page's stripped text; a blank page is the description alone."""
    both = pages.join(descriptions.select("doc_id", "page_num", "description"), ["doc_id", "page_num"], "left")
    shown = F.concat_ws(GAP, F.format_string(IMAGE, "description"), F.when(~blank(F.col("fused")), strip(F.col("fused"))))
    return both.withColumn("fused", F.when(F.col("description").isNotNull(), shown).otherwise(F.col("fused"))).drop("description")


def describe_documents(texts: DataFrame, descriptions: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Corrected texts (doc_id, text): all image descriptions by page in front, with the page's number if the document has several.

    page_counts (doc_id, page_count); a blank text is the descriptions alone.
    """
    single = F.coalesce("page_count", F.lit(1)) <= 1
    label = F.when(single, F.format_string(IMAGE, "description")).otherwise(F.format_string(IMAGE_ON_PAGE, F.col("page_num").cast("int"), F.col("description")))
    told = descriptions.filter("description is not null").join(page_counts, "doc_id", "left").withColumn("_label", label).groupBy("doc_id").agg(joined(["page_num"], "_label").alias("_told"))
    both = texts.join(told, "doc_id", "left")
    return both.withColumn("text", F.when(F.col("_told").isNull(), F.col("text")).otherwise(F.concat_ws(GAP, "_told", F.when(~blank(F.col("text")), F.col("text"))))).drop("_told")


def accept_correction(df: DataFrame, old: str, new: str) -> DataFrame:
    """Adds accepted and text: a correction counts if it isn't blank and is longer than 0.7 of the old text."""
    ok = F.coalesce(~blank(F.col(new)) & (F.length(new) > F.length(old) * ACCEPTED), F.lit(False))
    return df.withColumn("accepted", ok).withColumn("text", F.when(ok, F.col(new)).otherwise(F.col(old)))


def cells_to_text(cells: DataFrame, keep_empty: bool = False) -> DataFrame:
    """cells (doc_id, row_no, col_no, text) -> doc_id, text: cells of a row with ' | ' between, rows as lines, empty rows left out."""
    row = F.transform(F.array_sort(F.collect_list(F.struct("col_no", strip(F.coalesce("text", F.lit(""))).alias("t")))), lambda x: x["t"])
    rows = cells.groupBy("doc_id", "row_no").agg(row.alias("cells")).filter(F.exists("cells", lambda x: x != ""))
    shown = F.col("cells") if keep_empty else F.filter("cells", lambda x: x != "")
    return rows.withColumn("line", F.array_join(shown, " | ")).groupBy("doc_id").agg(joined(["row_no"], "line", "\n").alias("text"))


def review_or_markdown(df: DataFrame, markdown: str, ocr: str, answer: str) -> DataFrame:
    """Adds reviewed: '' if both inputs are blank, the answer if there is one, else the markdown."""
    return df.withColumn("reviewed", F.when(blank(F.col(markdown)) & blank(F.col(ocr)), "").otherwise(F.coalesce(F.col(answer), F.col(markdown))))
