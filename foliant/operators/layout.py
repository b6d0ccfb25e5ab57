"""Reading order of layout blocks, page text, and packets of text for boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import lines, strip
from foliant.operators.fusion import joined

# Shares of the page that decide the column layout.
WIDE, GUTTER, TOLERANCE, LEAST_BLOCKS, LEAST_SIDE, ROW = 0.68, 0.16, 0.025, 4, 2, 8
MARGIN_X, MARGIN_Y, MARGIN_LEAST = 0.04, 0.035, 18.0
PAGE = ["doc_id", "page_num"]


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """Blanks and tabs collapsed, ends stripped, empty blocks dropped."""
    return blocks.withColumn("text", strip(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t]+", " "))).filter("text <> ''")


def plain_order(blocks: DataFrame) -> DataFrame:
    """Adds reading_order: by rows of eight units, then from left to right."""
    w = Window.partitionBy(*PAGE).orderBy(F.rint(F.col("y0") / ROW), "x0", "block_no")
    return blocks.withColumn("reading_order", F.row_number().over(w) - 1)


def detect_columns(blocks: DataFrame) -> DataFrame:
    """Adds body, split_x (null: one column), body_top and body_bottom of the page to each cleaned block."""
    page = Window.partitionBy(*PAGE)
    out = blocks.withColumn("body", F.col("x1") - F.col("x0") < F.col("page_width") * WIDE).withColumn("centre", (F.col("x0") + F.col("x1")) / 2)
    order = Window.partitionBy(*PAGE, "body").orderBy("centre", "block_no")
    out = out.withColumn("_after", F.lead("centre").over(order)).withColumn("_at", F.row_number().over(order))
    gap = F.when(F.col("body") & F.col("_after").isNotNull(), F.struct((F.col("_after") - F.col("centre")).alias("gap"), F.col("_at").alias("at"), ((F.col("_after") + F.col("centre")) / 2).alias("split")))
    out = out.withColumn("_widest", F.max(gap).over(page)).withColumn("_n", F.count("*").over(page)).withColumn("_bodies", F.sum(F.col("body").cast("int")).over(page))
    left = F.col("body") & (F.col("centre") <= F.col("_widest.split"))
    out = out.withColumn("_left", F.sum(F.coalesce(left.cast("int"), F.lit(0))).over(page))
    two = (F.col("_n") >= LEAST_BLOCKS) & (F.col("page_width") > 0) & (F.col("_bodies") >= LEAST_BLOCKS) & (F.col("_widest.gap") >= F.col("page_width") * GUTTER)
    two = two & (F.col("_left") >= LEAST_SIDE) & (F.col("_bodies") - F.col("_left") >= LEAST_SIDE)
    out = out.withColumn("split_x", F.when(two, F.col("_widest.split")))
    out = out.withColumn("body_top", F.min(F.when(F.col("body"), F.col("y0"))).over(page)).withColumn("body_bottom", F.max(F.when(F.col("body"), F.col("y1"))).over(page))
    return out.drop("_after", "_at", "_widest", "_n", "_bodies", "_left", "centre")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Cleaned blocks with reading_order: header, left column, right column, full width between, footer; else rows."""
    out = detect_columns(clean_blocks(blocks))
    centre, slack = (F.col("x0") + F.col("x1")) / 2, F.col("page_height") * TOLERANCE
    two, body = F.col("split_x").isNotNull(), F.col("body")
    band = F.when(~two, 0).when(body & (centre <= F.col("split_x")), 1).when(body, 2)
    band = band.when(F.col("y1") <= F.col("body_top") + slack, 0).when(F.col("y0") >= F.col("body_bottom") - slack, 4).otherwise(3)
    row = F.when(two & body, F.col("y0")).otherwise(F.rint(F.col("y0") / ROW))
    w = Window.partitionBy(*PAGE).orderBy(band, row, "x0", "block_no")
    return out.withColumn("reading_order", F.row_number().over(w) - 1).drop("body", "split_x", "body_top", "body_bottom")


def blocks_to_page_text(ordered: DataFrame) -> DataFrame:
    return ordered.groupBy(*PAGE).agg(joined(["reading_order"], "text").alias("text"))


def layout_summary(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, pages, blocks, boxes (rounded to 2 places, by place), preview; pages without blocks count too."""
    box = F.concat_ws(",", *[F.format_string("%.2f", F.round(F.col(c), 2)) for c in ("x0", "y0", "x1", "y1")])
    first = F.array_sort(F.collect_list(F.struct("page_num", "block_no", box.alias("box"), F.substring("text", 1, 160).alias("shown"))))
    got = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), first.alias("all"))
    got = got.select("doc_id", "blocks", F.array_join(F.transform("all", lambda b: b["box"]), ";").alias("boxes"), F.get("all", F.lit(0))["shown"].alias("preview"))
    n = pages.groupBy("doc_id").agg(F.count_distinct("page_num").alias("pages"))
    return n.join(got, "doc_id", "left").select("doc_id", "pages", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("boxes", F.lit("")).alias("boxes"), F.coalesce("preview", F.lit("")).alias("preview"))


def paragraphs(c: Column) -> Column:
    parts = F.filter(F.transform(F.split(strip(c), r"(?U)\n\s*\n+"), strip), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.filter(F.transform(lines(c), strip), lambda p: p != ""))


def split_packets(c: Column, n: Column) -> Column:
    """Array of at most n packets of whole paragraphs with about the same number of letters.

    Packets fill in order. Each one's goal is what is left divided by the packets left; one takes paragraphs
    until it reaches its goal, and the last takes the rest.
    """
    parts = paragraphs(c)
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("held"),
        F.aggregate(parts, F.lit(0), lambda a, p: a + F.length(p)).alias("left"), n.cast("int").alias("slots"),
    )

    def add(s: Column, p: Column) -> Column:
        goal = F.greatest(F.lit(1), F.floor((s["left"] + s["held"]) / s["slots"]).cast("int"))
        close = (F.size(s["open"]) > 0) & (s["held"] >= goal) & (s["slots"] > 1)
        done = F.when(close, F.concat(s["done"], F.array(F.array_join(s["open"], "\n\n")))).otherwise(s["done"])
        opened = F.when(close, F.array(p)).otherwise(F.concat(s["open"], F.array(p)))
        held = F.when(close, F.length(p)).otherwise(s["held"] + F.length(p))
        return F.struct(done.alias("done"), opened.alias("open"), held.alias("held"), (s["left"] - F.length(p)).alias("left"), (s["slots"] - close.cast("int")).alias("slots"))

    packed = F.aggregate(parts, start, add, lambda s: F.concat(s["done"], F.array(F.array_join(s["open"], "\n\n"))))
    return F.when(strip(c) == "", F.array().cast("array<string>")).when((n <= 1) | (F.size(parts) <= n), parts).otherwise(packed)


def assign_packets(pages: DataFrame, ordered: DataFrame) -> DataFrame:
    """pages (doc_id, page_num, page_width, page_height, fused) and ordered blocks -> boxes with their packet.

    More packets than boxes: the rest is one more packet in the last box. No boxes: the page inside its margins.
    """
    edge = F.struct("reading_order", "x0", "y0", "x1", "y1")
    boxes = ordered.groupBy(*PAGE).agg(F.array_sort(F.collect_list(edge)).alias("boxes"))
    whole = pages.join(boxes, PAGE, "left").withColumn("n", F.coalesce(F.size("boxes"), F.lit(0)))
    whole = whole.withColumn("n", F.greatest("n", F.lit(0)))
    packets = whole.withColumn("packets", F.when(F.col("n") == 0, F.array("fused")).otherwise(split_packets(F.col("fused"), F.col("n"))))
    most = F.greatest("n", F.lit(1))
    single = F.transform(F.slice("packets", F.lit(1), most), lambda p, i: F.struct(i.alias("box"), F.lit(False).alias("over"), p.alias("packet")))
    rest = F.struct((F.col("n") - 1).alias("box"), F.lit(True).alias("over"), F.array_join(F.slice("packets", F.col("n") + 1, F.greatest(F.size("packets"), F.lit(1))), "\n\n").alias("packet"))
    placed = F.concat(single, F.when((F.col("n") > 0) & (F.size("packets") > F.col("n")), F.array(rest)).otherwise(F.slice(F.array(rest), 1, 0)))
    out = packets.select(*PAGE, "page_width", "page_height", "n", "boxes", F.explode(placed).alias("p")).select("*", "p.*")
    out = out.withColumn("b", F.get("boxes", F.col("box"))).select("*", "b.x0", "b.y0", "b.x1", "b.y1")
    mx, my = (F.greatest(F.lit(MARGIN_LEAST), F.col(c) * s) for c, s in (("page_width", MARGIN_X), ("page_height", MARGIN_Y)))
    edges = {"x0": (F.col("x0") - 1, mx), "y0": (F.col("y0") - 1, my), "x1": (F.col("x1") + 1, F.col("page_width") - mx), "y1": (F.col("y1") + 1, F.col("page_height") - my)}
    return out.select(*PAGE, "box", "over", *[F.when(F.col("n") > 0, a).otherwise(b).alias(c) for c, (a, b) in edges.items()], "packet")
