"""Op 4: benchmark passages in documents, found by winnowing, with DataFrame functions only.

Of every WINDOW - GRAM + 1 consecutive GRAM-word hashes the smallest is kept, in documents and in
items alike, so two texts that share WINDOW consecutive words share a kept hash inside them. Kept
hashes of items are broadcast with the words around them; a document's kept hashes probe them while
its words are still at hand, and each hit is extended word by word to both sides. Hits of at least
WINDOW words count. The hash (32 bits) only finds places; words decide. Items of fewer than WINDOW
words are looked up whole: for each such length (12 at most) every run of that many words probes.

A document's text is read and split once and isn't shuffled; what is shuffled is a row for each
document and one for each hit. That holds for up to BROADCAST_ROWS rows of at most 21 words, which are
broadcast. The fingerprints of a larger benchmark meet those of the documents in a shuffled join of
hashes; only documents with a hash in common are read again and shuffled, once, for their words.

A document is known by its doc_id and two hashes of its text, and how often it occurs is counted, so no
row needs a number that a lost executor could change.

Defined results: null and empty texts have no words and no hits, and items without words no windows.
Rows with the same doc_id are documents of their own. Items with a null item_id make hits but aren't
counted as items. Overlapping hits count each word once. An empty benchmark gives no hits, empty
documents an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, keep_columns, table

WINDOW, GRAM, BROADCAST_ROWS, SHARE = 13, 5, 100_000, 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOW = (1 << 31) - 1  # the position's bits of a packed fingerprint


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _pack(hashed: Column, at: Column) -> Column:
    """32 bits of the hash above 31 bits of the position: the smallest of a window is its leftmost smallest hash."""
    return F.shiftleft(hashed.bitwiseAND(F.lit(0xFFFFFFFF)), 31).bitwiseOR(at.cast("long"))


def with_fingerprints(df: DataFrame, text: str, window: int, gram: int, short: list[int] = ()) -> DataFrame:
    """df with w (words) and fingerprints (packed hash and position), of whole runs too for the lengths in short."""
    df = df.withColumn("w", words(F.col(text)))
    df = df.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("__h"))
    n = F.size("__h")
    grams = F.transform(
        F.slice("__h", F.lit(1), F.greatest(n - (gram - 1), F.lit(0))),
        lambda _, i: _pack(F.xxhash64(*[F.get(F.col("__h"), i + k) for k in range(gram)]), i),
    )
    df = df.select("*", grams.alias("__g"))
    span = window - gram + 1
    kept = F.array_distinct(
        F.transform(
            F.slice("__g", F.lit(1), F.greatest(F.size("__g") - (span - 1), F.lit(0))),
            lambda _, i: F.array_min(F.slice(F.col("__g"), i + 1, span)),
        )
    )

    def whole(k: int) -> Column:
        runs = F.slice("__h", F.lit(1), F.greatest(n - (k - 1), F.lit(0)))
        return F.transform(runs, lambda _, i: _pack(F.xxhash64(F.lit(k), F.slice(F.col("__h"), i + 1, k)), i))

    return df.select("*", F.concat(kept, *map(whole, short)).alias("fingerprints")).drop("__h", "__g")


def item_fingerprints(bench: DataFrame, window: int, gram: int) -> tuple[DataFrame, list[int]]:
    """k (hash), item, n (its window's words), words around the hash's place and the place in them; and the short lengths."""
    items = cut(keep_columns(bench, "item_id", "text").select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("iw"), F.col("text").alias("item_text")))
    short = sorted(r[0] for r in items.where((F.size("iw") > 0) & (F.size("iw") < window)).select(F.size("iw")).distinct().collect())
    made = with_fingerprints(items.drop("iw"), "item_text", window, gram)
    at = F.col("f").bitwiseAND(F.lit(LOW)).cast("int")
    side = window - gram
    start = F.greatest(at - side, F.lit(0))
    long = (
        made.where(F.size("w") >= window)
        .select("item", "w", F.explode(F.filter("fingerprints", lambda x: x >= 0)).alias("f"))
        .select(F.shiftright("f", 31).alias("k"), "item", F.lit(window).alias("n"), F.slice("w", start + 1, at + window - start).alias("around"), (at - start).alias("off"))
    )
    parts = [long]
    for k in short:
        whole = made.where(F.size("w") == k).select("item", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
        parts.append(whole.select(F.xxhash64(F.lit(k), F.col("h")).bitwiseAND(F.lit(0xFFFFFFFF)).alias("k"), "item", F.lit(k).alias("n"), F.col("w").alias("around"), F.lit(0).alias("off")))
    return cut(reduce(DataFrame.unionByName, parts).dropDuplicates(["k", "item", "n", "around", "off"])), short


def _same(window: int, gram: int) -> Column:
    """A character for each word from window - gram before the gram to as many after it: 1 where both texts have the same word."""
    return F.array_join(
        F.transform(
            F.sequence(F.lit(gram - window), F.lit(window - 1)),
            lambda j: F.when(F.get(F.col("near"), F.col("at") + j) == F.get(F.col("around"), F.col("off") + j), "1").otherwise("0"),
        ), "",
    )


OWN = ("doc_id", "h1", "h2")


def _known(docs: DataFrame) -> DataFrame:
    return keep_columns(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"), "text")


def _near(joined: DataFrame, window: int, gram: int, *more: Column) -> DataFrame:
    """OWN, n_words, item, n, p, k, around, off, and the words around p instead of the whole document's."""
    start = F.greatest(F.col("p") - (window - gram), F.lit(0))
    return joined.select(*OWN, F.size("w").alias("n_words"), "item", "n", "p", "k", "around", "off", *more, F.slice("w", start + 1, F.col("p") + window - start).alias("near"), (F.col("p") - start).alias("at"))


def _probe(docs: DataFrame, found: DataFrame, short: list[int], window: int, gram: int) -> DataFrame:
    """Hits of hashes, and a row with k = -1 for each document: found is broadcast."""
    made = with_fingerprints(_known(docs), "text", window, gram, short).select(*OWN, "w", F.concat(F.array(F.lit(-1).cast("long")), "fingerprints").alias("fingerprints"))
    # Every document's fingerprint -1 meets this row, so that documents without hits stay.
    own = docs.sparkSession.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit(None).cast("string").alias("item"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("around"), F.lit(0).alias("off"))
    exploded = made.select(*OWN, "w", F.explode_outer("fingerprints").alias("f")).select(  # not explode: it would infer a filter that computes the fingerprints again
        *OWN, "w", F.shiftright("f", 31).alias("k"), F.when(F.col("f") >= 0, F.col("f").bitwiseAND(F.lit(LOW)).cast("int")).otherwise(0).alias("p")
    )
    # The number here keeps Catalyst from testing hits inside the join, which would end its generated code.
    return _near(exploded.join(F.broadcast(found.unionByName(own)), "k"), window, gram, F.monotonically_increasing_id().alias("here"))


def _probe_by_hash(docs: DataFrame, found: DataFrame, short: list[int], window: int, gram: int) -> DataFrame:
    """The same for a benchmark that is too large to broadcast."""
    made = with_fingerprints(_known(docs), "text", window, gram, short)
    probes = made.select(*OWN, F.explode_outer("fingerprints").alias("f")).select(*OWN, F.shiftright("f", 31).alias("k"), F.col("f").bitwiseAND(F.lit(LOW)).cast("int").alias("p"))
    met = probes.join(found.select("k").distinct(), "k", "left_semi").groupBy(*OWN).agg(F.collect_set(F.struct("k", "p")).alias("met"))
    met = met.select(*[F.col(c).alias(f"__{c}") for c in OWN], "met")
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2"))
    again = _known(docs).join(met, same).select(*OWN, words(F.col("text")).alias("w"), F.explode("met").alias("m")).select(*OWN, "w", F.col("m.k").alias("k"), F.col("m.p").alias("p"))
    hits = _near(again.join(found, "k"), window, gram, F.lit(0).cast("long").alias("here"))
    kinds = {f.name: f.dataType for f in hits.schema}
    each = _known(docs).select(*OWN, F.size(words(F.col("text"))).alias("n_words"), F.lit(-1).cast("long").alias("k"), F.lit(0).cast("long").alias("here"))
    return hits.unionByName(each.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in kinds if c not in each.columns]))


def find_passages(docs: DataFrame, bench: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, hits (sorted spans [s, e) of words), items of each row of docs, and h1, h2 of its text."""
    found, short = item_fingerprints(bench, window, gram)
    joined = (_probe if found.count() <= broadcast_rows else _probe_by_hash)(docs, found, short, window, gram)
    side = window - gram
    joined = joined.select(*OWN, "n_words", "item", "n", "p", "k", "here",
        F.when(F.col("n") == window, _same(window, gram)).alias("same"),
        F.when((F.col("n") > 0) & (F.col("n") < window), F.slice("near", F.col("at") + 1, F.col("n")) == F.col("around")).alias("equal"))
    inner = F.substring("same", side + 1, gram) == "1" * gram
    joined = joined.withColumns({
        "before": F.when(inner, F.length(F.regexp_extract(F.substring("same", 1, side), "1*$", 0))),
        "after": F.when(inner, F.length(F.regexp_extract(F.substring("same", side + gram + 1, side), "^1*", 0))),
    })
    hit = (F.col("before") + gram + F.col("after") >= window) | F.col("equal")
    start = F.when(hit, F.when(F.col("equal"), F.col("p")).otherwise(F.col("p") - F.col("before")))
    end = F.when(hit, F.when(F.col("equal"), F.col("p") + F.col("n")).otherwise(F.col("p") + gram + F.col("after")))
    joined = joined.select(*OWN, "n_words", "k", "here", F.when(hit, F.col("item")).alias("item"), F.when(hit, F.struct(start.alias("s"), end.alias("e"))).alias("hit"))
    out = (
        joined.where(((F.col("k") == -1) | F.col("hit").isNotNull()) & (F.col("here") >= 0))
        .groupBy(*OWN)
        .agg(F.count_if(F.col("k") == -1).cast("int").alias("times"), F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set("hit")).alias("hits"), F.array_sort(F.collect_set("item")).alias("items"))
    )
    n_hit = F.aggregate("hits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("e")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["e"]))).cast("long").alias("n"), F.greatest(a["e"], x["e"]).alias("e")),
        lambda a: a["n"])
    out = out.select(*OWN, "n_words", n_hit.alias("n_hit"), "hits", "items", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return out.drop("copy")


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, bench: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs without contaminated rows; from the others the words of each hit are cut, with what stands before them.

    The text of a row without hits isn't touched. Rows are matched by doc_id and the text's two hashes.
    """
    hit = cut(find_passages(docs, bench, broadcast_rows=broadcast_rows).where("n_hit > 0").select(
        F.col("doc_id").alias("__id"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("hits").alias("__hits"), is_contaminated().alias("__drop")
    ).dropDuplicates(["__id", "__h1", "__h2"]))
    side = F.broadcast(hit) if hit.count() <= broadcast_rows else hit
    piece = F.regexp_extract_all(F.col("text"), F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    rest = F.regexp_extract("text", r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)\z", 1)
    kept = F.filter(F.col("__pieces"), lambda _, i: ~F.exists("__hits", lambda h: (h["s"] <= i) & (i < h["e"])))
    joined = docs.join(side, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__h1")) & (F.xxhash64(F.lit("second"), "text") == F.col("__h2")), "left").where(~F.coalesce("__drop", F.lit(False)))
    joined = joined.withColumn("__pieces", F.when(F.col("__hits").isNotNull(), piece)).select("*", F.when(F.col("__hits").isNotNull(), F.concat(F.array_join(kept, ""), rest)).alias("__text"))
    return joined.select(*[F.coalesce("__text", "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, item_id, p, n FROM grams JOIN windows USING (n, g)
), hit_words AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
