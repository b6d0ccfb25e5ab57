from pyspark.sql import functions as F

from foliant.operators import fusion, layout, quality


def test_normalize_amount(one):
    for raw, want in (("1.234,56", "1234,56"), ("-12,34", "-12,34"), ("+1.234.567,89", "1234567,89")):
        assert one(quality.normalize_amount(F.col("a")), a=raw) == want


def test_extraction(one):
    t = "Betrag: 1.234,56 EUR, Abzug: -150,00 EUR. Fällig am 20.05.2026. 1234,56 Konto 4711 seit 1999"
    assert set(one(quality.extract_amounts(F.col("t")), t=t)) == {"1234,56", "-150,00"}
    assert one(quality.extract_dates(F.col("t")), t=t) == ["20.05.2026"]
    assert "4711" in one(quality.extract_codes(F.col("t")), t=t) and "1999" not in one(quality.extract_codes(F.col("t")), t=t)
    assert one(quality.extract_amounts(F.col("t")), t=None) == []


def report(spark, fused):
    row = ("Rechnung 1.234,56 vom 20.05.2026", "| 1.234,56 |", "1.234,56", fused)
    return quality.quality_report(spark.createDataFrame([row], "ocr string, docling string, vision string, fused string")).first()


def test_report(spark):
    assert (report(spark, "Rechnung 1.234,56 vom 20.05.2026")["severity"], report(spark, "Rechnung 1.234,56 vom 20.05.2026")["warnings"]) == ("info", [])
    lost = report(spark, "Rechnung vom 20.05.2026.")
    assert lost["severity"] == "error" and [m["value"] for m in lost["missing"]] == ["1.234,56"]


def test_looping(one):
    assert one(quality.is_looping(F.col("t")), t="104,00 EUR Σ " * 20)
    for t in ("", "abc", "a" * 400, "".join(f"wort{i} " for i in range(80))):
        assert not one(quality.is_looping(F.col("t")), t=t)


def test_text_stats(spark):
    r = quality.text_stats(spark.createDataFrame([(1, "Alpha Beta Gamma " * 20), (2, ""), (3, None)], "doc_id long, text string"), shown=12).orderBy("doc_id").collect()
    assert (r[0]["chars"], r[0]["words"], r[0]["preview"]) == (340, 60, "Alpha Beta G")
    assert (r[1]["words"], r[1]["sha256"], r[2]["chars"]) == (0, "", 0)


def test_best_source(spark):
    rows = [(1, "v", "g", "d", "o"), (2, " ", "g", "d", "o"), (3, "", "", "d", "o"), (4, "", None, "\n", "o"), (5, "", "", "", "")]
    got = fusion.best_source(spark.createDataFrame(rows, "doc_id long, vision string, glm string, docling string, ocr string")).orderBy("doc_id").collect()
    assert [r["best_source"] for r in got] == ["vision", "glm", "docling", "ocr", None]


def test_fuse_blank_answer(spark):
    rows = [(1, "v", "", "", "", "  "), (2, "v", "", "", "", "M"), (3, "", "", "", "", "M")]
    got = fusion.fuse_pages(spark.createDataFrame(rows, "doc_id long, vision string, glm string, docling string, ocr string, model string")).orderBy("doc_id").collect()
    assert [(r["fused"], r["status"]) for r in got] == [("v", "degraded"), ("M", "ok"), ("", "skipped")]


BLOCK = "doc_id long, page_num int, block_no int, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, text string"


def test_two_columns(spark):
    at = [(40, 20, 560, "header"), (45, 80, 250, "left top"), (330, 80, 550, "right top"), (45, 130, 250, "left bottom"), (330, 130, 550, "right bottom")]
    rows = [(1, 1, i, float(x0), float(y), float(x1), float(y + 30), 600.0, 800.0, t) for i, (x0, y, x1, t) in enumerate(at)]
    got = layout.reading_order(spark.createDataFrame(rows, BLOCK)).orderBy("reading_order").collect()
    assert [r["text"] for r in got] == ["header", "left top", "left bottom", "right top", "right bottom"]
    assert layout.reading_order(spark.createDataFrame([], BLOCK)).count() == 0


def packets(text, n):
    """Brute force of the greedy filling."""
    rest = [p.strip() for p in text.split("\n\n") if p.strip()]
    if n <= 1 or len(rest) <= n:
        return rest
    out = []
    for slots in range(n, 0, -1):
        if slots == 1:
            out.append("\n\n".join(rest))
            break
        goal, now, held = max(1, sum(map(len, rest)) // slots), [], 0
        while rest and (not now or held < goal):
            held += len(rest[0])
            now.append(rest.pop(0))
        out.append("\n\n".join(now))
    return [p for p in out if p]


def test_packets(spark, one):
    assert one(layout.split_packets(F.col("t"), F.lit(2)), t="A\n\nB\n\nC\n\nD") == ["A\n\nB", "C\n\nD"]
    assert one(layout.split_packets(F.col("t"), F.lit(3)), t=" ") == []
    texts = ["\n\n".join("x" * (1 + (i * k) % 17) for i in range(1, 5 + k)) for k in range(1, 12)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 2, 3, 5):
        assert [r["p"] for r in df.select(layout.split_packets(F.col("t"), F.lit(n)).alias("p")).collect()] == [packets(t, n) for t in texts]


def test_answers(spark):
    rows = [(1, 2, "b"), (1, 1, "a<think>x\ny</think>"), (1, 3, "c"), (2, 1, "z")]
    got = quality.assemble_answers(spark.createDataFrame(rows, "request_id long, seq int, text string"), 2)
    assert {r["request_id"]: r["answer"] for r in got.collect()} == {1: "ab", 2: "z"}


def test_texts_are_searched_once(spark):
    """Eleven searches of a page's four texts, and its digits and lines counted once, also below what Spark infers from an explode."""
    pages = spark.range(3).selectExpr("id AS doc_id", "id AS page_num", *(f"concat('Betrag ', id, ',50 vom 01.02.2024 {c}') AS {c}" for c in ("ocr", "docling", "vision", "fused")))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    lost = quality.exploded(quality.missing_values(pages), ["doc_id"])
    assert plan(lost).count("regexp_extract_all(") == 11
    long = pages.selectExpr("doc_id", "page_num", "stack(3, 'ocr', ocr, 'docling', docling, 'vision', vision) AS (channel, text)")
    assert plan(quality.missing_rows(long, pages)).count("regexp_extract_all(") == 11
    assert plan(quality.quality_report(pages)).count(r"[^\p{Nd}]") == 2


def test_borders_beside_letters_of_any_script(spark):
    texts = ["-1.234,56 x-7,89", "é12,34 12,34é", "3,45́ 1-2,22", "01.02.2024é 31.12.1999 111.12.2000", "1234 é123 123é 12345 789 0456"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = {quality.AMOUNT: r"(?U)-?\b[0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2}\b", quality.DATE: r"(?U)\b[0-9]{2}\.[0-9]{2}\.[0-9]{4}\b", quality.CODE: r"(?U)\b[0-9]{3,4}\b"}
    for fast, slow in plain.items():
        assert df.filter(~quality.found(F.col("t"), fast).eqNullSafe(quality.found(F.col("t"), slow))).isEmpty()
