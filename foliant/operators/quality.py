"""Facts lost between extraction channels and the fused text: amounts, dates, codes, digits, table lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import lines, strip
from foliant.operators.fusion import pivot_channels

# Patterns and limits that results depend on. Each looks for a digit first: only there is the border of
# a word, which takes many times as long to tell, looked at.
AMOUNT = r"(?U)(?=-?[0-9])-?\b[0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2}\b"
DATE = r"(?U)(?=[0-9]{2}\.)\b[0-9]{2}\.[0-9]{2}\.[0-9]{4}\b"
CODE = r"(?U)(?=[0-9]{3})\b[0-9]{3,4}\b"
PAYROLL = "(?i)abrechnung|gehalt|lohn|verdienst"  # no letter beyond ASCII has one of these as its lower case
# What reports say.
MISSING = {"amount": "Geldbetrag fehlt im Enddokument: ", "date": "Datum fehlt im Enddokument: ", "la_code": "Möglicher Lohnarten-Code (LA) fehlt: "}
UNITS = {"amount": " EUR"}
DIGITS_LOST = "Hoher Ziffernverlust im Enddokument! Nur %s der Ziffern aus der OCR erhalten (%d von %d)."
LINES_LOST = "Verlust von Tabellenzeilen vermutet: Quell-Markdown hat %d Zeilen mit Tabellen-Trennern '|', das fusionierte Dokument hat nur %d."
DIGITS_KEPT, LINES_KEPT, LINES_FEW = 0.80, 0.7, 5
LOOP_SHORTEST, LOOP_TOTAL = 6, 180
DAMAGED = ["Ã", "Â", "â€", "ðŸ", "�"]


def normalize_amount(c: Column) -> Column:
    """Without thousands dots and spaces, plain minus, no leading plus."""
    return F.regexp_replace(F.translate(c, "−. ", "-"), r"^\+", "")


def found(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def extract_amounts(c: Column) -> Column:
    return F.array_distinct(F.transform(found(c, AMOUNT), normalize_amount))


def extract_dates(c: Column) -> Column:
    return F.array_distinct(found(c, DATE))


def code(x: Column) -> Column:
    """Is it no year?"""
    return ~x.cast("int").between(1900, 2100)


def extract_codes(c: Column) -> Column:
    """3-4 digit codes that can't be years (1900 to 2100)."""
    return F.array_distinct(F.filter(found(c, CODE), code))


def missing_values(df: DataFrame, sources: tuple[str, str, str] = ("ocr", "docling", "vision"), fused: str = "fused") -> DataFrame:
    """Adds ``missing``: array of (type, value) in the sources but not in the fused text, by type and value.

    Amounts show the spelling that the sources have last. Codes come from the first two sources, and count
    only where the text looks like payroll.
    """
    ocr, docling, vision = map(F.col, sources)
    texts = {"_ocr": ocr, "_docling": docling, "_vision": vision, "_fused": F.col(fused)}
    once = {f"{k}_{name}": found(c, pattern) for k, c in texts.items() for name, pattern in (("amount", AMOUNT), ("date", DATE), ("code", CODE)) if (k, name) != ("_vision", "code")}
    each = df.withColumns(once)  # every text is searched once for each pattern
    spellings = F.transform(F.flatten(F.array("_ocr_amount", "_docling_amount", "_vision_amount")), lambda r: F.struct(normalize_amount(r).alias("norm"), r.alias("raw")))
    each = each.withColumns({"_raw": spellings, "_kept": F.transform("_fused_amount", normalize_amount)})

    def lost(name: str, channels: tuple[str, ...]) -> Column:
        there = F.array_except(F.flatten(F.array(*[f"{k}_{name}" for k in channels])), f"_fused_{name}")
        return F.sort_array(F.filter(there, code) if name == "code" else there)

    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    gone = F.sort_array(F.array_except(F.transform("_raw", lambda r: r["norm"]), F.col("_kept")))
    amounts = named("amount", F.transform(gone, lambda m: F.element_at(F.filter("_raw", lambda r: r["norm"] == m), -1)["raw"]))
    dates = named("date", lost("date", ("_ocr", "_docling", "_vision")))
    payroll = F.concat(ocr, F.col(fused)).rlike(PAYROLL)
    codes = F.when(payroll, named("la_code", lost("code", ("_ocr", "_docling")))).otherwise(F.array().cast("array<struct<type:string,value:string>>"))
    return each.withColumn("missing", F.concat(amounts, dates, codes)).select(*df.columns, "missing")


def exploded(df: DataFrame, keys: list[str], values: str | Column = "missing") -> DataFrame:
    """One row ``m`` for each element. From an inner ``explode`` Spark infers a filter on the size, under which it would search all texts once more."""
    return df.select(*keys, F.explode_outer(values).alias("m")).filter("m is not null")


def missing_rows(long: DataFrame, fused: DataFrame) -> DataFrame:
    """Corpus form: (doc_id, page_num, channel, text) and (doc_id, page_num, fused) -> one row a missing value (type, value).

    Channels meet their page's fused text by page, in one exchange of each table.
    """
    pages = fused.select("doc_id", "page_num", "fused").join(pivot_channels(long), ["doc_id", "page_num"], "left").na.fill("")
    return exploded(missing_values(pages), ["doc_id", "page_num"]).select("doc_id", "page_num", "m.type", "m.value")


def digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{Nd}]", ""))


def digit_ratio(source: Column, fused: Column) -> Column:
    return F.when(digits(source) > 0, digits(fused) / digits(source)).otherwise(1.0)


def table_lines(c: Column) -> Column:
    return F.size(F.filter(lines(c), lambda x: x.contains("|")))


def table_loss(source: Column, fused: Column) -> Column:
    return (table_lines(source) > LINES_FEW) & (table_lines(fused) < table_lines(source) * LINES_KEPT)


def quality_report(df: DataFrame, sources: tuple[str, str, str] = ("ocr", "docling", "vision"), fused: str = "fused") -> DataFrame:
    """Adds severity, warnings, missing and the metrics of each row."""
    ocr, docling, _ = map(F.col, sources)
    counts = {"source_digits": digits(ocr), "fused_digits": digits(F.col(fused)), "source_table_lines": table_lines(docling), "fused_table_lines": table_lines(F.col(fused))}
    out = missing_values(df, sources, fused).withColumns({f"_{k}": c for k, c in counts.items()})  # every text is counted once
    had, has, rows, left = (F.col(f"_{k}") for k in counts)
    ratio, loss = F.when(had > 0, has / had).otherwise(1.0), (rows > LINES_FEW) & (left < rows * LINES_KEPT)
    text = lambda names: F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    said = F.transform("missing", lambda m: F.concat(text(MISSING)[m["type"]], m["value"], F.coalesce(text(UNITS)[m["type"]], F.lit(""))))
    none = F.array().cast("array<string>")
    shown = F.concat(F.call_function("format_number", ratio * 100, F.lit("0.0")), F.lit("%"))
    lost = F.format_string(DIGITS_LOST, shown, has, had)
    few = F.format_string(LINES_LOST, rows, left)
    said = F.concat(said, F.when(ratio < DIGITS_KEPT, F.array(lost)).otherwise(none), F.when(loss, F.array(few)).otherwise(none))
    severity = F.when(ratio < DIGITS_KEPT, "error").when((F.size("missing") > 0) | loss, "warning").otherwise("info")
    return out.select(
        *df.columns, "missing", severity.alias("severity"), said.alias("warnings"),
        had.alias("source_digits"), has.alias("fused_digits"), F.round(ratio, 3).alias("digit_ratio"),
        rows.alias("source_table_lines"), left.alias("fused_table_lines"),
    )


def text_stats(df: DataFrame, text: str = "text", shown: int = 160) -> DataFrame:
    """Adds chars, nonspace_chars, nonblank_lines, words, sha256 ('' for an empty text) and a preview."""
    c = F.coalesce(F.col(text), F.lit(""))
    stripped = strip(c)
    return df.select(
        *[x for x in df.columns if x != text],
        F.length(c).alias("chars"), F.length(F.regexp_replace(c, r"(?U)\s", "")).alias("nonspace_chars"),
        F.size(F.filter(lines(c), lambda x: strip(x) != "")).alias("nonblank_lines"),
        F.when(stripped == "", 0).otherwise(F.size(F.split(stripped, r"(?U)\s+"))).alias("words"),
        F.when(c == "", "").otherwise(F.sha2(c, 256)).alias("sha256"), strip(F.substring(c, 1, shown)).alias("preview"),
    )


def is_looping(c: Column) -> Column:
    """Does the text end in a pattern of 6 to 90 letters repeated over 180 letters or more?

    A text ends in k copies of n letters where its last k * n letters, less the first n, equal them less the last n.
    """
    end = F.when(F.length(c) <= 2 * LOOP_TOTAL, c).otherwise(F.substring(c, -2 * LOOP_TOTAL, 2 * LOOP_TOTAL))

    def repeats(tail: Column, n: Column) -> Column:
        run = F.ceil(F.lit(LOOP_TOTAL) / n).cast("int") * n
        start = F.length(tail) - run
        same = (start >= 0) & (F.substring(tail, start + 1, run - n) == F.substring(tail, start + 1 + n, run - n))
        pattern = F.right(tail, n)
        return same & (strip(pattern) != "") & (F.size(F.array_distinct(F.split(pattern, ""))) > 2)

    # The tail is taken once, as the element of an array.
    found = F.exists(F.array(end), lambda tail: F.exists(F.sequence(F.lit(LOOP_SHORTEST), F.lit(LOOP_TOTAL // 2)), lambda n: repeats(tail, n)))
    return (F.length(c) >= LOOP_TOTAL) & found


def mojibake(c: Column) -> Column:
    """Does the text hold a mark of damaged encoding?"""
    return F.exists(F.array(*map(F.lit, DAMAGED)), lambda m: F.contains(c, m))


def assemble_answers(tokens: DataFrame, most: int = 4096) -> DataFrame:
    """tokens (request_id, seq, text) -> request_id, answer: the first tokens in order, without thoughts."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("request_id").orderBy("seq"))
    kept = tokens.withColumn("place", place).filter(F.col("place") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("place", "text")))
    answer = F.array_join(F.transform(ordered, lambda x: x["text"]), "")
    return kept.groupBy("request_id").agg(F.regexp_replace(answer, r"(?s)<think>.*?</think>", "").alias("answer"))
