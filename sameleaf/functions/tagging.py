"""Taggers split text into words with part-of-speech tags; any function of this shape can take their place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def simple_tagger(text: Column) -> Column:
    """Words between spaces. Numbers are m, words with other signs x, capitalised words nr, long words n, others v."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    tag = lambda w: F.when(w.rlike(r"^[0-9]+$"), "m").when(~w.rlike(r"^\p{L}+$"), "x").when(w.rlike(r"^\p{Lu}"), "nr").when(F.length(w) >= 5, "n").otherwise("v")
    return F.transform(words, lambda w: F.struct(w.alias("word"), tag(w).alias("tag")))
