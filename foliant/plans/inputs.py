"""Operator inputs derived from the given tables, in SQL that Spark and DuckDB both read.

Tables stand in braces; braces of the text itself are doubled. ``frame`` gives the rows to Spark, ``text`` the same SQL with plain table names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from foliant.functions.joins import spread

_CENTS = "min(cast(round(l_extendedprice * 100) AS bigint))"
_EUROS = "cast(floor(cents / 100) AS bigint)"

#: One row per invoice page: order, line, amount in cents, date.
INVOICES = f"""SELECT l_orderkey AS doc_id, l_linenumber AS page_num, {_CENTS} AS cents, min(o_orderdate) AS day,
    min(l_partkey) AS part, l_orderkey * 7 + l_linenumber AS k
    FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_linenumber"""

#: Invoice pages with amount and date as German text, and a 3-4 digit code.
FACTS = f"""SELECT doc_id, page_num, k, cents,
    concat(CASE WHEN {_EUROS} >= 1000 THEN concat(cast(cast(floor({_EUROS} / 1000) AS bigint) AS string), '.', lpad(cast({_EUROS} % 1000 AS string), 3, '0'))
        ELSE cast({_EUROS} AS string) END, ',', lpad(cast(cents % 100 AS string), 2, '0')) AS amount,
    concat(lpad(cast(day(day) AS string), 2, '0'), '.', lpad(cast(month(day) AS string), 2, '0'), '.', cast(year(day) AS string)) AS date,
    cast(100 + part % 2100 AS string) AS code FROM ({INVOICES}) AS i"""

_LINE = "concat('Abrechnung vom ', date, ': Betrag ', amount, ' EUR, Konto ', code)"
_TABLE = "concat('| Datum | Betrag |\n| --- | --- |\n| ', date, ' | ', amount, ' |\n| a | b |\n| c | d |\n| e | f |')"

#: Long form: one row per page and channel; some channels are missing, some blank.
PAGE_TEXT = f"""SELECT doc_id, page_num, 'ocr' AS channel, {_LINE} AS text FROM ({FACTS}) AS f WHERE k % 11 <> 0
    UNION ALL SELECT doc_id, page_num, 'docling', {_TABLE} FROM ({FACTS}) AS f WHERE k % 3 <> 0
    UNION ALL SELECT doc_id, page_num, 'glm', concat('Betrag ', amount) FROM ({FACTS}) AS f WHERE k % 5 = 0
    UNION ALL SELECT doc_id, page_num, 'vision', CASE WHEN k % 14 = 0 THEN ' ' ELSE concat('-', amount, ' am ', date) END FROM ({FACTS}) AS f WHERE k % 2 = 0"""

#: The four channels side by side ('' where missing) and what a model made of them (null where it gave no answer).
CHANNELS = f"""SELECT doc_id, page_num,
    CASE WHEN k % 11 <> 0 THEN {_LINE} ELSE '' END AS ocr,
    CASE WHEN k % 3 <> 0 THEN {_TABLE} ELSE '' END AS docling,
    CASE WHEN k % 5 = 0 THEN concat('Betrag ', amount) ELSE '' END AS glm,
    CASE WHEN k % 2 <> 0 THEN '' WHEN k % 14 = 0 THEN ' ' ELSE concat('-', amount, ' am ', date) END AS vision,
    CASE WHEN k % 4 = 0 THEN NULL WHEN k % 7 = 0 THEN concat('Zusammenfassung vom ', date) WHEN k % 13 = 0 THEN '' ELSE {_LINE} END AS model
    FROM ({FACTS}) AS f"""

#: Layout blocks: up to seven a page, in two columns with full-width header and footer where the key says so.
BLOCKS = """SELECT doc_id, page_num, block_no, 600.0D AS page_width, 800.0D AS page_height,
    CASE WHEN block_no % 7 = 1 OR doc_id % 3 = 0 THEN 40.0D WHEN block_no % 2 = 0 THEN 45.0D ELSE 330.0D END AS x0,
    CASE WHEN block_no % 7 = 1 OR doc_id % 3 = 0 THEN 560.0D WHEN block_no % 2 = 0 THEN 250.0D ELSE 550.0D END AS x1,
    cast(20 + 50 * ((block_no * 5 + doc_id) % 13) AS double) AS y0, cast(50 + 50 * ((block_no * 5 + doc_id) % 13) AS double) AS y1,
    CASE WHEN block_no = 5 AND doc_id % 4 = 0 THEN '  ' ELSE concat('Block  ', cast(block_no AS string), ' Teil ', cast(part AS string)) END AS text
    FROM (SELECT l_orderkey AS doc_id, 1 AS page_num, l_partkey AS part,
        cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS int) AS block_no FROM {lineitem}) AS b""".replace("0D", "0E0")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Rows of lineitem that one task sorts and groups, at most about, unless one order has more; and the key by which it meets orders.
A_TASK, KEY = 250_000, {"lineitem": "l_orderkey", "orders": "o_orderkey"}
#: Rows of part that one task takes terms from; each gives some ten.
DOCS_A_TASK = 50_000


def parts(rows: DataFrame, a_task: int) -> int | None:
    """How many parts a table's rows ask for; none where the session's number will do."""
    n = -(-rows.count() // a_task)  # Parquet knows it
    return n if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def tables(spark: SparkSession, sf_dir: str, sql: str) -> dict[str, DataFrame]:
    """The tables of a text. Lines that meet by order, with the orders they join, come in as many parts as their number asks for.

    What follows is by order too and stays in these parts, so a task's rows don't grow with the table. The same holds for
    documents made of part, whose terms are counted by document.
    """
    found = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    if ("GROUP BY l_orderkey" in sql or "PARTITION BY l_orderkey" in sql) and (n := parts(found["lineitem"], A_TASK)):
        found |= {t: spread(found[t].repartition(n, k)) for t, k in KEY.items() if t in found}
    if "p_partkey AS doc_id" in sql and "meta_text" in sql and (n := parts(found["part"], DOCS_A_TASK)):
        found["part"] = found["part"].repartition(n, "p_partkey")
    return found


def paged(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """As ``frame``, for texts that are grouped by page: these too come in as many parts as lineitem asks for."""
    n = parts(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), A_TASK)
    return frame(spark, sf_dir, sql).repartition(n, "doc_id", "page_num") if n else frame(spark, sf_dir, sql)


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **tables(spark, sf_dir, sql))


def text(sql: str) -> str:
    return re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", sql).replace("{{", "{").replace("}}", "}")
