"""Structure of Markdown text: kinds of lines, tables, cells, column widths, emphasis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import strip

#: Width that a table's columns share, and a column's least width.
WIDTH, NARROW = 6.0, 0.5


def classify_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, pos, kind, level, line (stripped), content: table, blank, heading, bullet, numbered or paragraph."""
    c = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "</?table_block>", "")
    rows = docs.select("doc_id", F.posexplode(F.split(c, "\n")).alias("pos", "line")).withColumn("line", strip(F.col("line")))
    heading, numbered = r"(?sU)^(#{1,6})\s+(.*)", r"(?sU)^(\d+)\.\s+(.*)"
    line = F.col("line")
    kind = F.when(F.startswith(line, F.lit("|")), "table").when(line == "", "blank").when(line.rlike(heading), "heading")
    kind = kind.when(F.startswith(line, F.lit("- ")) | F.startswith(line, F.lit("* ")), "bullet").when(line.rlike(numbered), "numbered").otherwise("paragraph")
    rows = rows.withColumn("kind", kind)
    content = F.when(F.col("kind") == "heading", F.regexp_extract(line, r"^#{1,6}\s+(.*)$", 1)).when(F.col("kind") == "bullet", F.substring(line, 3, 1 << 30)).when(F.col("kind") == "numbered", F.regexp_extract(line, r"^\d+\.\s+(.*)$", 1)).otherwise(line)
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract(line, "^(#{1,6})", 1))).otherwise(0)
    return rows.select("doc_id", "pos", "kind", level.alias("level"), "line", content.alias("content"))


def table_runs(classified: DataFrame) -> DataFrame:
    """Table lines with table_no: consecutive lines are one table, counted from 1; separator lines are dropped."""
    doc = Window.partitionBy("doc_id").orderBy("pos")
    tables = classified.filter("kind = 'table'").withColumn("_run", F.col("pos") - F.row_number().over(doc))
    numbered = tables.withColumn("table_no", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_run")))
    bars = F.length("line") - F.length(F.replace(F.col("line"), F.lit("|"), F.lit("")))
    separator = F.col("line").rlike(r"^\|\s*[-:]+\s*\|") | ((bars > 1) & F.col("line").rlike(r"^[ |:-]*$"))
    return numbered.filter(~separator).select("doc_id", "table_no", "pos", "line")


def table_cells(runs: DataFrame) -> DataFrame:
    """doc_id, table_no, row_no, col_no, cell, header, columns: outer parts dropped, first kept row is the header."""
    rows = runs.withColumn("row_no", F.row_number().over(Window.partitionBy("doc_id", "table_no").orderBy("pos")) - 1)
    parts = F.split("line", r"\|")
    inner = F.when(F.size(parts) > 2, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("cells", F.transform(inner, strip))
    rows = rows.withColumn("columns", F.max(F.size("cells")).over(Window.partitionBy("doc_id", "table_no")))
    return rows.select("doc_id", "table_no", "row_no", F.posexplode("cells").alias("col_no", "cell"), (F.col("row_no") == 0).alias("header"), "columns")


def column_widths(cells: DataFrame) -> DataFrame:
    """doc_id, table_no, col_no, width: its longest cell's share of the width, at least NARROW."""
    longest = cells.groupBy("doc_id", "table_no", "col_no").agg(F.greatest(F.max(F.length("cell")), F.lit(1)).alias("longest"))
    total = F.sum("longest").over(Window.partitionBy("doc_id", "table_no"))
    return longest.select("doc_id", "table_no", "col_no", F.greatest(F.lit(NARROW), F.col("longest") / total * WIDTH).alias("width"))


def emphasis_spans(classified: DataFrame) -> DataFrame:
    """doc_id, pos, span_no, style, span: bold and italic parts of each line, in order."""
    marks = F.regexp_extract_all("content", F.lit(r"\*\*.*?\*\*|\*.*?\*"), F.lit(0))
    rows = classified.select("doc_id", "pos", F.posexplode(marks).alias("span_no", "raw"))
    bold = F.startswith("raw", F.lit("**")) & F.endswith("raw", F.lit("**")) & (F.length("raw") >= 4)
    span = F.when(bold, F.expr("substring(raw, 3, length(raw) - 4)")).otherwise(F.expr("substring(raw, 2, length(raw) - 2)"))
    return rows.select("doc_id", "pos", "span_no", F.when(bold, "bold").otherwise("italic").alias("style"), span.alias("span"))
