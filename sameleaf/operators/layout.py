"""Reading order from glyph runs: font groups, lines, paragraphs and sentences, as gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PAGE = ("file_hash", "page")


def _island(new: Column, part: list[str], order: str) -> Column:
    return F.sum(new.cast("int")).over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def _joined(order: str, value: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "")


def font_groups(runs: DataFrame, page: tuple[str, ...] = PAGE) -> DataFrame:
    """Runs with a height and a text, and the group each is in: a new one wherever the height changes."""
    runs = runs.where((F.coalesce("height", F.lit(0.0)) != 0) & (F.coalesce("str", F.lit("")) != ""))
    w = Window.partitionBy(*page).orderBy("seq")
    new = F.coalesce(F.col("height") != F.lag("height").over(w), F.lit(True))
    return runs.withColumn("__new", new).withColumn("font_group", _island(F.col("__new"), [*page], "seq")).drop("__new")


def lines(runs: DataFrame, page: tuple[str, ...] = PAGE) -> DataFrame:
    """Runs of a font group at one height of the page, no further apart than a glyph is high, as one line."""
    runs = font_groups(runs, page)
    part = [*page, "font_group"]
    w = Window.partitionBy(*part).orderBy("seq")
    gap = F.abs(F.lag("x").over(w) + F.lag("width").over(w) - F.col("x"))
    same = (F.col("y") == F.lag("y").over(w)) & (gap < F.col("height"))
    runs = runs.withColumn("__new", ~F.coalesce(same, F.lit(False))).withColumn("line", _island(F.col("__new"), part, "seq"))
    made = runs.groupBy(*part, "line").agg(
        _joined("seq", "str").alias("str"), F.min("seq").alias("seq"), F.max("height").alias("height"), F.sum("width").alias("width"),
        F.min_by("x", "seq").alias("x_s"), F.min_by("y", "seq").alias("y_s"), F.max("page_width").alias("page_width"),
    )
    return made.withColumns({"x_e": F.col("x_s") + F.col("width"), "y_e": F.col("y_s") + F.col("height")})


def paragraphs(runs: DataFrame, page: tuple[str, ...] = PAGE, tolerance: float = 10.0) -> DataFrame:
    """A line goes on the one before it if that one is centred on the page, give or take twice the height and the tolerance."""
    made = lines(runs, page)
    part = [*page, "font_group"]
    w = Window.partitionBy(*part).orderBy("seq")
    off = F.abs(F.lag("x_e").over(w) + F.lag("x_s").over(w) - F.col("page_width"))
    made = made.withColumn("__new", ~F.coalesce(off < 2 * F.col("height") + tolerance, F.lit(False))).withColumn("paragraph", _island(F.col("__new"), part, "seq"))
    return made.groupBy(*part, "paragraph").agg(_joined("seq", "str").alias("text"), F.min("seq").alias("seq"), F.count("*").alias("n_lines"))


def page_sentences(runs: DataFrame, page: tuple[str, ...] = PAGE, compose: bool = True) -> DataFrame:
    """The page's sentences in reading order: page, ord, text, vector."""
    made = paragraphs(runs, page).where(F.col("text") != "")
    made = made.select(*page, "font_group", "paragraph", F.posexplode(T.clean_sentences(F.col("text"), compose)).alias("k", "text"))
    order = F.row_number().over(Window.partitionBy(*page).orderBy("font_group", "paragraph", "k")) - 1
    return made.select(*page, order.alias("ord"), "text").withColumn("vector", T.vector(F.col("text")))
