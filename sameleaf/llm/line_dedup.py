"""Op 1: lines that many documents share are dropped, by probing a sharded minimal perfect hash.

1. Each document gives its distinct line keys as 128-bit hashes; a partial count by key shuffles
   hashes, never text, so a line of all documents is one row per task.
2. Keys that reach the limit are dealt to shards by their first hash. Each shard is one task's work:
   it builds a minimal perfect hash (levels of bit arrays; a key rests at the first level where
   nothing else falls on its bit) and lays out a fingerprint array (the whole second hash, so a key
   that isn't in the set passes with probability 2^-64) and a count array in the order of the slots.
   Keys below the limit aren't indexed, as no count of theirs could drop a line. Keys whose first hash
   another key has, too, stand apart in a list.
3. Documents probe. Arrays up to BROADCAST_BYTES in all are broadcast, and each document is done in
   place. Beyond that, hashes go to the shards instead (see _probe_by_shard): the keys of more than
   1 / HOT_PART of all probes, of which there can be at most HOT_PART, are broadcast and probed in
   place; the others are spread by shard, and a task holds the arrays of a shard while it streams
   the probes.

Defined results: null and empty text are one empty line, of 0 code points, and are never dropped;
lines that are empty after stripping stay. A document that repeats a line counts once. Repeated rows
(same doc_id) count as separate documents, in the SQL, too. Empty input gives empty output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, keep_columns, lean, table

MIN_DOCS, MIN_CHARS = 10, 1
#: Keys in a shard, about; bytes of all shards that may be broadcast; probes by shard keep keys above this part at home.
SHARD_KEYS, BROADCAST_BYTES, HOT_PART = 100_000, 64 << 20, 10_000
STRIP = b" \t\n\x0b\x0c\r"
MIX = np.uint64(0x9E3779B97F4A7C15)


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text, and their keys, as UTF-8."""
    lines = (text or "").encode("utf-8").split(b"\n")
    return lines, [x.strip(STRIP).lower() for x in lines]


def hashes(keys: list[bytes]) -> np.ndarray:
    """An array of (first, second) for each key, as int64."""
    return np.array([(d >> 64, d & 0xFFFFFFFFFFFFFFFF) for d in map(xxhash.xxh3_128_intdigest, keys)], np.uint64).reshape(-1, 2).view(np.int64)


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8")) >= min_chars)


# ---- minimal perfect hash


def _at(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h.view(np.uint64) ^ np.uint64(level * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)) * MIX
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """Maps each of n distinct int64 keys to its own slot of 0..n-1, with about 4 bits a key."""

    def __init__(self, levels: list[tuple[int, np.ndarray]]):
        self.levels, start = [], 0
        for bits, packed in levels:
            ones = np.bitwise_count(packed)
            before = np.concatenate(([0], np.cumsum(ones, dtype=np.int64)))
            self.levels.append((bits, packed, start + before))
            start += int(before[-1])
        self.size = start

    @staticmethod
    def build(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
        levels = []
        while len(keys):
            bits = max(64, -(-2 * len(keys) // 64) * 64)
            at = _at(keys, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append((bits, np.packbits(alone, bitorder="little").view(np.uint64)))
            keys = keys[~alone[at]]
        return levels

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 or any slot for a key that isn't in the set."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, packed, before) in enumerate(self.levels):
            if not len(left):
                break
            at = _at(keys[left], level, bits)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            here = (packed[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(packed[word[here]] & ((np.uint64(1) << bit[here]) - np.uint64(1)))
            out[left[here]] = before[word[here]] + below
            left = left[~here]
        return out


SHARD_SCHEMA = "shard long, bits array<long>, levels array<binary>, fingerprints binary, counts binary, more binary, bytes long"
PARTS = ("bits", "levels", "fingerprints", "counts", "more")


def pack_shard(shard: int, h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> dict:
    first = np.unique(h1, return_index=True)[1]
    more = np.setdiff1d(np.arange(len(h1)), first)  # keys whose first hash another key has, too: a few in 10^10
    more = np.stack([h1[more], h2[more], n[more].astype(np.int64)], 1)
    h1, h2, n = h1[first], h2[first], n[first]
    levels = PerfectHash.build(h1)
    slot = PerfectHash(levels).slots(h1)
    prints, counts = np.empty(len(h1), np.int64), np.empty(len(h1), np.uint32)
    prints[slot], counts[slot] = h2, np.minimum(n, 0xFFFFFFFF)
    out = {"shard": shard, "bits": [b for b, _ in levels], "levels": [x.tobytes() for _, x in levels], "fingerprints": prints.tobytes(), "counts": counts.tobytes(), "more": more.tobytes()}
    return out | {"bytes": 12 * len(h1) + 24 * len(more) + sum(map(len, out["levels"]))}


class Shard:
    def __init__(self, row):
        self.hash = PerfectHash([(b, np.frombuffer(x, np.uint64)) for b, x in zip(row["bits"], row["levels"], strict=True)])
        self.prints, self.counts = np.frombuffer(row["fingerprints"], np.int64), np.frombuffer(row["counts"], np.uint32)
        self.more = np.frombuffer(row["more"], np.int64).reshape(-1, 3)

    def count(self, h: np.ndarray) -> np.ndarray:
        """The number of documents for each (first, second) hash; 0 where it isn't in the set."""
        slot = self.hash.slots(np.ascontiguousarray(h[:, 0]))
        out = np.zeros(len(h), np.int64)
        known = np.flatnonzero(slot >= 0)
        known = known[self.prints[slot[known]] == h[known, 1]]
        out[known] = self.counts[slot[known]]
        for first, second, n in self.more.tolist():
            out[(h[:, 0] == first) & (h[:, 1] == second)] = n
        return out


def shard_of(h1, shards: int):
    return (h1.view(np.uint64) >> np.uint64(3)) % np.uint64(shards)


# ---- the operator


def shared_lines(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """h1, h2, n of each line key found in at least min_docs rows of docs."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, int] = {}
            for text in batch.column(0).to_pylist():
                for k in set(line_keys(text)[1]):
                    if _long_enough(k, min_chars):
                        found[k] = found.get(k, 0) + 1
            h = hashes(list(found))
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(list(found.values()), pa.int64())], ["h1", "h2", "n"])

    counted = keep_columns(docs, "text").mapInArrow(lean(distinct), "h1 long, h2 long, n long")
    return counted.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)


def build_shards(lines: DataFrame, shards: int) -> DataFrame:
    """A row for each shard of the key set, with its hash and arrays; a shard has about SHARD_KEYS keys."""

    def build(key, pdf):
        import pandas as pd

        return pd.DataFrame([pack_shard(int(key[0]), pdf.h1.to_numpy(), pdf.h2.to_numpy(), pdf.n.to_numpy())])

    shard = F.pmod(F.shiftrightunsigned("h1", 3), F.lit(shards)).alias("shard")
    return lines.select(shard, "h1", "h2", "n").groupBy("shard").applyInPandas(build, SHARD_SCHEMA)


def _apply(columns: list[str], count, min_docs: int, min_chars: int, schema: str, texts: bool):
    """A function over batches of rows that drops lines; count gives each hash's number of documents."""

    def dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = count()
        for batch in batches:
            rows = [line_keys(x) for x in batch.column("text").to_pylist()]
            flat = [k for _, keys in rows for k in keys]
            out = look(hashes(flat)) >= min_docs
            if min_chars > 0:
                out &= np.fromiter((_long_enough(k, min_chars) for k in flat), bool, len(flat))
            yield _results(batch, columns, rows, out, texts)

    return dropped


def _results(batch, columns, rows, out, texts) -> pa.RecordBatch:
    at, n_lines, n_dropped, last = 0, [], [], []
    for k, (lines, _) in enumerate(rows):
        drop = out[at : at + len(lines)]
        at += len(lines)
        n_lines.append(len(lines))
        n_dropped.append(int(drop.sum()))
        kept = b"\n".join([x for x, d in zip(lines, drop, strict=True) if not d]) if n_dropped[-1] else b"\n".join(lines)
        if not texts:
            last.append(hashlib.sha256(kept).hexdigest())
        else:
            last.append(batch.column("text")[k].as_py() if not n_dropped[-1] else kept.decode("utf-8"))
    own = [batch.column(c) for c in columns]
    return pa.RecordBatch.from_arrays([*own, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(last, pa.string())], [*columns, "n_lines", "n_dropped", "kept_text" if texts else "kept_sha256"])


def drop_shared_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, texts: bool = False, carry: tuple[str, ...] = ("doc_id",), broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The columns in carry, n_lines, n_dropped, and kept_text or kept_sha256 of each row of docs."""
    spark = docs.sparkSession
    docs = keep_columns(docs, *dict.fromkeys([*carry, "text"]))
    lines = cut(shared_lines(docs, min_docs, min_chars))
    shards = max(1, -(-lines.count() // SHARD_KEYS))
    arrays = cut(build_shards(lines, shards))
    size = arrays.agg(F.sum("bytes")).first()[0] or 0
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "n_lines long", "n_dropped long", "kept_text string" if texts else "kept_sha256 string"])
    if size > broadcast_bytes:
        return _probe_by_shard(docs, lines, arrays, shards, min_docs, min_chars, schema, list(carry), texts)
    held = spark.sparkContext.broadcast({r["shard"]: r.asDict() for r in arrays.collect()})

    def count():
        own = {k: Shard(r) for k, r in held.value.items()}

        def look(h: np.ndarray) -> np.ndarray:
            out, to = np.zeros(len(h), np.int64), shard_of(np.ascontiguousarray(h[:, 0]), shards)
            for k, shard in own.items():
                if len(own) == 1:
                    return shard.count(h)
                mine = np.flatnonzero(to == k)
                out[mine] = shard.count(h[mine])
            return out

        return look

    return docs.mapInArrow(lean(_apply(list(carry), count, min_docs, min_chars, schema, texts)), schema)


def _probe_by_shard(docs, lines, arrays, shards, min_docs, min_chars, schema, carry, texts) -> DataFrame:
    """For arrays that are too large to broadcast: hashes travel to the shards, hits travel back.

    A probe is (row, h1, h2); a row's number comes from its place in the input, kept in a written
    table so that both sides see the same numbers. Keys of more than 1 / HOT_PART of all line
    counts are at most HOT_PART, are broadcast, and their probes stay at home.
    """
    spark = docs.sparkSession
    docs = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    total = lines.agg(F.sum("n")).first()[0] or 1
    hot = lines.where(F.col("n") * HOT_PART > total).select("h1", "h2").collect()
    hot = spark.sparkContext.broadcast({(r["h1"], r["h2"]) for r in hot})

    def probes(batches):
        for batch in batches:
            rows, ids = [], batch.column("__row").to_pylist()
            for i, text in zip(ids, batch.column("text").to_pylist(), strict=True):
                keys = [k for k in set(line_keys(text)[1]) if _long_enough(k, min_chars)]
                rows += [(i, *x) for x in map(tuple, hashes(keys).tolist()) if x not in hot.value]
            h = np.array(rows, np.int64).reshape(-1, 3)
            to = shard_of(np.ascontiguousarray(h[:, 1]), shards).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(to), *(pa.array(h[:, k]) for k in range(3))], ["shard", "row", "h1", "h2"])

    sent = keep_columns(docs, "__row", "text").mapInArrow(lean(probes), "shard long, row long, h1 long, h2 long")
    wide = arrays.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), *PARTS)
    narrow = sent.select("shard", F.lit(1).alias("kind"), "row", "h1", "h2", *[F.lit(None).cast(arrays.schema[c].dataType).alias(c) for c in PARTS])

    def answer(batches):
        shard = key = None
        for batch in batches:
            kinds, at = batch.column("kind").to_pylist(), batch.column("shard").to_pylist()
            h = np.stack([batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("row", "h1", "h2")], axis=1)
            start = 0
            for k in [*[k for k, x in enumerate(kinds) if x == 0], len(kinds)]:
                if k > start and key is not None:
                    mine = h[start:k]
                    mine = mine[shard.count(np.ascontiguousarray(mine[:, 1:])) >= min_docs]
                    yield pa.RecordBatch.from_arrays([pa.array(mine[:, c]) for c in range(3)], ["row", "h1", "h2"])
                if k < len(kinds):
                    row = {c: batch.column(c)[k].as_py() for c in PARTS}
                    shard, key, start = Shard(row), at[k], k + 1

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    hits = wide.unionByName(narrow).repartition(parts, "shard").sortWithinPartitions("shard", "kind").mapInArrow(lean(answer), "row long, h1 long, h2 long")
    hits = hits.groupBy(F.col("row").alias("__row")).agg(F.collect_list(F.struct("h1", "h2")).alias("__hits"))
    joined = docs.join(hits, "__row", "left").select(*carry, *(["text"] if "text" not in carry else []), "__hits")

    def finish(batches):
        for batch in batches:
            rows = [line_keys(x) for x in batch.column("text").to_pylist()]
            found = [{(x["h1"], x["h2"]) for x in hits or ()} for hits in batch.column("__hits").to_pylist()]
            out = [(x in f or x in hot.value) and _long_enough(k, min_chars) for (_, keys), f in zip(rows, found, strict=True) for k, x in zip(keys, map(tuple, hashes(keys).tolist()), strict=True)]
            yield _results(batch, carry, rows, np.array(out, bool), texts)

    return joined.mapInArrow(lean(finish), schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_shared_lines(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, text FROM documents
), lines AS (
  SELECT row, doc_id, u.line, u.ord,
    translate(regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM d, unnest(string_split(coalesce(text, ''), chr(10))) WITH ORDINALITY AS u(line, ord)
), shared AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10
), marked AS (
  SELECT l.*, s.key IS NOT NULL AS dropped FROM lines l LEFT JOIN shared s ON l.key = s.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY row
"""
