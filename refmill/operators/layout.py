"""Reading order of page lines with coordinates: noise, line numbers in margins, columns, fragments of one line, margins where entries begin.

Lines are rows (doc, page, line_no, x0, y0, x1, y1, text, page_width, page_height); what holds for a page is an
aggregate over its lines, a page being bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refmill.functions.predicates import is_publisher_noise
from refmill.functions.text import clean_text

PAGE = ["doc", "page"]
#: Fixed values, in points or parts of the page: edges of noise, margins, columns, gaps.
HEADER, FOOTER, FAR_RIGHT, TALL = 42, 70, 0.95, 0.25
OUTER, NUMBERS, IN_SEQUENCE, DENSE, ALIGNED = 0.18, 4, 0.80, 3.2, 12.0
GUTTER, COLUMN_LINES = 8, 4
BASELINE, OVERLAP, GAP, SPACE = 1.2, -2, 80, 1.5
SPANNING, HINT = 4, 2.8
BLOCK_NARROW, BLOCK_TALL = 0.04, 0.45


def kept_blocks(blocks: DataFrame) -> DataFrame:
    """blocks (x0, y0, x1, y1, text, page_width, page_height) that aren't tall and narrow nor a publisher's notice."""
    thin = (F.col("x1") - F.col("x0") < F.col("page_width") * BLOCK_NARROW) & (F.col("y1") - F.col("y0") > F.col("page_height") * BLOCK_TALL)
    return blocks.where(~thin & ~is_publisher_noise(F.col("text")))


def is_noise() -> Column:
    running = F.col("text").rlike(r"(?i)\b(?:page\s*)?[0-9]+\s+of\s+[0-9]+\b|\b[A-Z ]+MAGAZINE\b")
    return (
        is_publisher_noise(F.col("text"))
        | ((F.col("y1") <= HEADER) & running)
        | ((F.col("y0") >= F.col("page_height") - FOOTER) & F.col("text").rlike("^[0-9]{1,4}$"))
        | ((F.col("x0") >= F.col("page_width") * FAR_RIGHT) & (F.col("y1") - F.col("y0") > F.col("page_height") * TALL))
    )


def _side() -> Column:
    number = F.col("text").rlike("^[0-9]{1,6}$")
    return F.when(number & (F.col("x1") <= F.col("page_width") * OUTER), "left").when(number & (F.col("x0") >= F.col("page_width") * (1 - OUTER)), "right")


def numbered_margins(lines: DataFrame) -> DataFrame:
    """(doc, page, side): margins that hold a run of line numbers: enough of them, nearly all counting up, close together and aligned."""
    rows = lines.withColumns({"side": _side(), "value": F.col("text").try_cast("int")}).where("side is not null")
    before = Window.partitionBy(*PAGE, "side").orderBy("y0", "line_no")
    rows = rows.withColumns({"step": F.col("value") - F.lag("value").over(before), "gap": F.col("y0") - F.lag("y0").over(before)})
    height = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    runs = rows.groupBy(*PAGE, "side").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("step").isNotNull(), F.col("step").between(1, 10).cast("double"))).alias("up"),
        F.median(F.when(F.col("gap") > 0, F.col("gap"))).alias("gap"), F.median(height).alias("height"), (F.max("x0") - F.min("x0")).alias("spread"),
    )
    return runs.where((F.col("n") >= NUMBERS) & (F.col("up") >= IN_SEQUENCE) & (F.col("gap") <= F.col("height") * DENSE) & (F.col("spread") <= ALIGNED)).select(*PAGE, "side")


def without_line_numbers(lines: DataFrame) -> DataFrame:
    """lines without the numbers of numbered_margins()."""
    return lines.withColumn("side", _side()).join(numbered_margins(lines), [*PAGE, "side"], "left_anti").drop("side")


def _column() -> Column:
    middle = F.col("page_width") / 2
    return F.when((F.col("x1") <= middle + GUTTER) & (F.col("x0") < middle - GUTTER), "left").when(F.col("x0") >= middle - GUTTER, "right").otherwise("span")


def with_columns(lines: DataFrame) -> DataFrame:
    """lines with column (left, right or span) and two_columns: whether the page is set in two."""
    rows = lines.withColumn("column", _column())
    n = {k: F.count_if(F.col("column") == k).over(Window.partitionBy(*PAGE)) for k in ("left", "right", "span")}
    return rows.withColumn("two_columns", (n["left"] >= COLUMN_LINES) & (n["right"] >= COLUMN_LINES) & (n["span"] < F.greatest(n["left"], n["right"])))


def merge_fragments(lines: DataFrame) -> DataFrame:
    """lines (with two_columns) with the fragments of one baseline put together, line by line and from left to right, within a column where there are two.

    How far a line reaches depends on what was joined to it, so each page is folded as an array of its lines.
    """
    rows = lines.groupBy(*PAGE, "page_width", "page_height", "two_columns").agg(
        F.array_sort(F.collect_list(F.struct(F.round("y0", 1).alias("y"), "x0", "line_no", "y0", "x1", "y1", "text"))).alias("items")
    )
    made = "array<struct<line_no:bigint,x0:double,y0:double,x1:double,y1:double,text:string>>"

    def as_line(x: Column) -> Column:
        return F.struct(x["line_no"].cast("bigint").alias("line_no"), x["x0"].alias("x0"), x["y0"].alias("y0"), x["x1"].alias("x1"), x["y1"].alias("y1"), x["text"].alias("text"))

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        gap = x["x0"] - last["x1"]
        one_column = ~F.col("two_columns") | ((last["x0"] < F.col("page_width") / 2) == (x["x0"] < F.col("page_width") / 2))
        joins = (F.size(a) > 0) & one_column & (F.abs(last["y0"] - x["y0"]) <= BASELINE) & gap.between(OVERLAP, GAP)
        text = F.concat(last["text"], F.when(gap > SPACE, F.lit(" ")).otherwise(F.lit("")), x["text"])
        longer = F.struct(last["line_no"].alias("line_no"), last["x0"].alias("x0"), last["y0"].alias("y0"), F.greatest(last["x1"], x["x1"]).alias("x1"), F.greatest(last["y1"], x["y1"]).alias("y1"), text.alias("text"))
        return F.when(joins, F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(a, F.array(as_line(x))))

    # element_at of an empty array isn't asked for: the fold begins with the first line
    start = F.array(as_line(F.element_at("items", 1))).cast(made)
    folded = F.aggregate(F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(0))), start, step)
    return rows.select(*PAGE, "page_width", "page_height", "two_columns", F.explode(folded).alias("l")).select(*PAGE, "page_width", "page_height", "two_columns", "l.*")


def reading_order(lines: DataFrame) -> DataFrame:
    """(doc, page, place, line_no, x0, y0, x1, y1, text, page_width): the lines of each page in the order they are read.

    One column: from top to bottom. Two: what spans them above, the left one, what spans them between, the right one, what spans them below.
    """
    rows = merge_fragments(with_columns(without_line_numbers(lines.where("text <> ''").where(~is_noise())))).withColumn("column", _column())
    page = Window.partitionBy(*PAGE)
    inner = F.col("column") != "span"
    rows = rows.withColumns({"top": F.min(F.when(inner, F.col("y0"))).over(page), "bottom": F.max(F.when(inner, F.col("y1"))).over(page)})
    band = (
        F.when(~F.col("two_columns"), 0).when(F.col("column") == "left", 1).when(F.col("column") == "right", 3)
        .when(F.col("y1") <= F.col("top") + SPANNING, 0).when(F.col("y0") >= F.col("bottom") - SPANNING, 4).otherwise(2)
    )
    y = F.when(F.col("two_columns"), F.col("y0")).otherwise(F.round("y0", 1))
    order = page.orderBy(band, y, "x0", "line_no")
    return rows.withColumn("place", F.row_number().over(order)).select(*PAGE, "place", "line_no", "x0", "y0", "x1", "y1", "text", "page_width")


def with_start_hints(ordered: DataFrame) -> DataFrame:
    """reading_order() lines with hint: whether a line stands at the margin of its half of the page, the leftmost place of lines of three letters or more."""
    half = F.col("x0") < F.col("page_width") / 2
    margin = F.min(F.when(F.length("text") >= 3, F.round("x0", 1))).over(Window.partitionBy(*PAGE, "half"))
    rows = ordered.withColumn("half", half).withColumn("margin", margin)
    return rows.withColumn("hint", F.coalesce(F.abs(F.col("x0") - F.col("margin")) <= HINT, F.lit(False))).drop("half", "margin")


def lines_from_spans(spans: DataFrame) -> DataFrame:
    """(doc, page, line_no, text) of spans (doc, page, line_no, x0, x1, text): pieces of a line from left to right, a blank between those more than SPACE apart; empty lines are left out."""
    item = F.struct("x0", "x1", "text")
    rows = spans.groupBy(*PAGE, "line_no").agg(F.array_sort(F.collect_list(item)).alias("items"))
    put = F.aggregate(
        F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(0))),
        F.struct(F.element_at("items", 1)["text"].alias("t"), F.element_at("items", 1)["x1"].alias("e")),
        lambda a, x: F.struct(F.concat(a["t"], F.when((x["x0"] - a["e"] > SPACE) & ~a["t"].endswith(" "), F.lit(" ")).otherwise(F.lit("")), x["text"]).alias("t"), x["x1"].alias("e")),
        lambda a: a["t"],
    )
    return rows.select(*PAGE, "line_no", clean_text(put).alias("text")).where("text <> ''")
