"""Text functions. All are expressions of Spark's own, but for NFKC, which Spark lacks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as ECMAScript has it; Java's \s is ASCII only.
SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
TERMINATORS = "!?;。！？；‼‽⁇⁈⁉"
SENTENCE = rf"([^{TERMINATORS}]+([{TERMINATORS}]|$))"
FULLWIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
HALFWIDTH = "".join(map(chr, range(0x21, 0x7F)))
#: The same white space, character by character.
SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
BRACKETS = ("()", "（）", "【】", "[]", "{}", "<>", "《》", "“”")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units, which differs from length() beyond the basic plane."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


@F.pandas_udf(StringType())
def nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility composition, by Arrow batches."""
    for s in parts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def halfwidth(c: Column) -> Column:
    return F.translate(c, FULLWIDTH, HALFWIDTH)


def squeeze(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(F.translate(c, SPACES, " " * len(SPACES)), "  +", " "))


def sentences(c: Column) -> Column:
    """An array of sentences, each with one terminator at most. What follows a terminator keeps its leading space."""
    return F.filter(F.regexp_extract_all(c, F.lit(SENTENCE), F.lit(0)), lambda s: s != "")


def clean_sentences(c: Column, compose: bool = False) -> Column:
    """sentences(squeeze(halfwidth(c))), with patterns of Latin-1 characters only.

    Java tests a class with other characters by a chain of predicates whose calls write to memory that all
    threads of an executor share, so that tasks side by side slow each other down many times. Squeezed
    texts have no line feed: one after each of the other terminators stands for them."""
    made = squeeze(halfwidth(nfkc(c) if compose else c))
    other = [x for x in TERMINATORS if ord(x) > 255 and x not in FULLWIDTH]
    latin = "".join(x for x in TERMINATORS if ord(x) < 256) + r"\n"
    for x in other:
        made = F.replace(made, F.lit(x), F.lit(x + "\n"))
    found = F.regexp_extract_all(made, F.lit(f"[^{latin}]+([{latin}]|$)"), F.lit(0))
    return F.transform(F.filter(found, lambda s: ~s.isin("", *[x + "\n" for x in other])), lambda s: F.translate(s, "\n", ""))


def vector(c: Column) -> Column:
    """How often each UTF-16 code unit occurs, as a map.

    A unit is its character; those of characters beyond the basic plane, which a string can't hold alone,
    are named by four hexadecimal digits."""
    plain = F.filter(F.array_distinct(F.split(c, "")), lambda x: x != "")
    counted = F.map_from_arrays(plain, F.transform(plain, lambda x: (F.length(c) - F.length(F.replace(c, x))) / F.length(x))).cast("map<string,int>")
    beyond = lambda x: F.ascii(x) - 0x10000
    name = lambda n: F.lpad(F.hex(n), 4, "0")
    units = F.flatten(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.when(F.ascii(x) < 0x10000, F.array(x)).otherwise(F.array(name(F.shiftright(beyond(x), 10) + 0xD800), name(beyond(x) % 1024 + 0xDC00)))))
    slow = F.map_from_arrays(F.array_distinct(units), F.transform(F.array_distinct(units), lambda x: F.size(F.filter(units, lambda y: y == x))))
    return F.when(c.rlike(r"[\x{10000}-\x{10FFFF}]"), slow).otherwise(counted)


def norm2(v: Column) -> Column:
    return F.aggregate(F.map_values(v), F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.map_keys(a), F.lit(0).cast("long"), lambda s, k: s + F.try_element_at(a, k).cast("long") * F.coalesce(F.try_element_at(b, k), F.lit(0)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a side is empty. Two roots, not the root of a product: thresholds are sensitive to the last bit."""
    return F.coalesce(F.try_divide(dot(a, b).cast("double"), F.sqrt(norm2(a)) * F.sqrt(norm2(b))), F.lit(0.0))


def in_range(ratio: Column, t: float) -> Column:
    """t <= ratio <= 2 - t. It isn't symmetric: a pair may pass one way round only."""
    return (ratio >= F.lit(float(t))) & (ratio <= F.lit(2.0 - float(t)))


def brackets_balanced(c: Column) -> Column:
    """Each kind of bracket opens as often as it closes; order doesn't count."""
    ok = F.lit(True)
    for left, right in BRACKETS:
        ok = ok & (F.length(F.translate(c, left, "")) == F.length(F.translate(c, right, "")))
    return ok


def base64_text(c: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(c), r"[\r\n]", "")


def unbase64_text(c: Column) -> Column:
    """Also without padding, and with the URL-safe letters."""
    plain = F.regexp_replace(F.translate(c, "-_", "+/"), r"[\s=]", "")
    return F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "="))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def duration(ms: Column) -> Column:
    """Days, hours and minutes where there are any, and seconds always."""
    s = F.floor(F.coalesce(ms, F.lit(0)) / 1000).cast("long")
    parts = [(F.floor(s / 86400), "天"), (F.floor(s % 86400 / 3600), "小时"), (F.floor(s % 3600 / 60), "分钟")]
    shown = [F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("") for n, unit in parts]
    return F.concat(*shown, (s % 60).cast("string"), F.lit("秒"))


def percent(done: Column, total: Column) -> Column:
    return F.format_string("%.4f", done.cast("double") / total.cast("double"))
