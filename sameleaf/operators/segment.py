"""Sentences of texts whose lines stand for paragraphs, and filters on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def line_sentences(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, page (the line, from 1), ord, text of each sentence of each line."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "l"))
    made = lines.select(key, (F.col("line") + 1).alias("page"), F.posexplode(T.clean_sentences(F.col("l"))).alias("k", "text"))
    order = F.row_number().over(Window.partitionBy(key).orderBy("page", "k")) - 1
    return made.select(key, "page", order.alias("ord"), "text")


def with_vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("vector", T.vector(F.col("text")))


def at_least(df: DataFrame, n: int) -> DataFrame:
    """Sentences of n UTF-16 code units or more."""
    return df.where(T.utf16_length(F.col("text")) >= n)


PAINTS = ("paintImageXObject", "paintInlineImageXObject", "paintInlineImageXObjectGroup", "paintImageXObjectRepeat", "paintXObject")


def image_first(images: DataFrame) -> DataFrame:
    """Paint operations named img_..., one for each page, name and size, and one for each document and name: the first.

    If there are columns op (the operation's name) and found (whether the reference could be resolved), other
    operations and images that weren't found go before that."""
    images = images.where(F.col("name").startswith("img_"))
    if "op" in images.columns:
        images = images.where(F.col("op").isin(*PAINTS))
    if "found" in images.columns:
        images = images.where(F.coalesce("found", F.lit(False)))
    for part in (["file_hash", "page", "name", "width", "height"], ["file_hash", "name"]):
        r = F.row_number().over(Window.partitionBy(*part).orderBy("page", "ord"))
        images = images.withColumn("__r", r).where("__r = 1").drop("__r")
    return images
