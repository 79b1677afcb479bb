"""Op 6: nearest neighbours by cosine from a hash-prefix forest.

Each of up to TREES trees gives a vector a string of 64 signs of random projections. A tree is a sorted
array of these strings, cut into buckets at the quantiles of a sample; every row is in every tree. A
query descends to its longest matching prefix and then ascends in all trees at once: the level is the
deepest at which all trees together hold as many candidates as it wants. In each tree the candidates
with that prefix are one range of the array; it may span buckets, and the query goes to each of them.

How many trees and candidates are wanted is fitted: for HELD rows the TOP nearest of *all* rows are
found exactly in one pass, which also counts how many rows share each prefix with them. Of the choices
that find GOAL of those neighbours the cheapest is taken. So where neighbours are near, the number of
candidates is a matter of the data's density and stays as n grows. Where they are hardly nearer than
the rest, no prefix tells them apart, and the fit ascends to the root of one tree, which is an exact
scan: the work is then the number of queries times n. Prefix counts come from a sample of about SAMPLE
rows' strings; below a count of FEW in it each further level is taken to halve the count.

Rows with equal vectors are one entry of the index, so a vector of a third of all rows is one key. Of
its ids the TOP + 1 smallest are kept, which is exact, as the others can't be among TOP nearest. A
string that many different vectors share is dealt to as many buckets as its share of the sample asks
for. A task holds one bucket and streams the queries that come to it; of each it hands on the TOP + 1
best by score and id, which is exact, too. Scores are the cosine in double precision, of vectors scaled
by a power of two, which changes no digit.

Defined results: vectors that are null, zero, or hold nulls or non-finite numbers take no part, nor do
those of another length than the most common one. Repeated rows of one id count once; of different
vectors of one id the smallest counts. A query has fewer than TOP rows where there are fewer
candidates. Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, keep_columns, table

TOP, EVERY, TREES, BUCKET, LARGEST, SAMPLE, HELD, GOAL, SALTS, FEW = 5, 50, 16, 2000, 100_000, 65_536, 64, 0.95, 64, 8
#: Levels that the fit tells apart; what a copy of a row costs, in scores of a candidate.
DEPTH, COPY = 32, 100


def planes(dim: int, trees: int = TREES) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((trees, dim, 64))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that their squares neither vanish nor overflow."""
    _, e = np.frexp(np.abs(x).max(1, initial=0))
    return np.ldexp(x, -e[:, None])


def keys(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(trees, rows) strings of 64 bits, the first projection's sign highest."""
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    return np.stack([((x @ q) > 0).astype(np.uint64) @ weights for q in p])


def prefix_range(key: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and largest string that share the first `level` bits."""
    rest = (np.uint64(64) - level.astype(np.uint64))
    mask = np.where(rest >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(rest, np.uint64(63))) - np.uint64(1))
    return key & ~mask, key | mask


def levels(key: np.ndarray, arrays: np.ndarray, wanted: float) -> np.ndarray:
    """For each query (trees, queries): the deepest level at which the trees' arrays hold at least `wanted` in all.

    wanted may be a fraction: levels below that of FEW are taken to halve the count each."""
    deeper = max(0, int(np.log2(FEW / wanted))) if 0 < wanted < FEW else 0
    out, open_ = np.zeros(key.shape[1], np.int64), np.ones(key.shape[1], bool)
    for level in range(64, 0, -1):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        total = np.zeros(len(at))
        for own, array in zip(key, arrays, strict=True):
            low, high = prefix_range(own[at], np.full(len(at), level))
            total += np.searchsorted(array, high, "right") - np.searchsorted(array, low, "left")
        hit = at[total >= max(wanted, FEW)]
        out[hit], open_[hit] = level, False
    return np.minimum(out + deeper * (wanted < FEW), 64)


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the first DEPTH bits strings share."""
    return DEPTH - np.frexp(((a ^ b) >> np.uint64(64 - DEPTH)).astype(np.float64))[1]


def choices(trees: int) -> list[int]:
    """The numbers of trees that are tried."""
    return [t for t in (1, 2, 4, 8, 16, 32) if t <= trees]


def choose(n: int, every: int, key: np.ndarray, arrays: np.ndarray, counts: np.ndarray, near: list[list[list[int]]], goal: float) -> tuple[int, float]:
    """(trees, candidates wanted) that find `goal` of the held rows' neighbours at the least cost.

    counts (choice, query, level): rows whose prefix of that level a query has, in all trees of the choice.
    near: for each query and neighbour, the longest prefix that they share in the trees of each choice."""
    best = (n / every + COPY, 1, np.inf)
    total, sample = sum(map(len, near)), arrays.shape[1]
    for c, trees in enumerate(choices(len(arrays))):
        wanted = 32.0
        while wanted < n * trees:
            level = np.minimum(levels(key[:trees], arrays[:trees], wanted * sample / n), DEPTH)
            found = sum(x[c] >= level[q] for q, own in enumerate(near) for x in own)
            cost = counts[c, np.arange(len(level)), level].mean() / every + COPY * trees
            if found >= goal * total and cost < best[0]:
                best = (cost, trees, wanted)
            wanted *= 2
    return best[1:]


def _signed(x: np.ndarray) -> np.ndarray:
    """Unsigned order kept in signed numbers."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if len(column) else pa.array([], pa.float64())
    return scaled(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def _cosine(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Of two tables' rows, each by itself, so that it doesn't depend on what else is computed."""
    return np.einsum("ij,ij->i", q, e) / (np.sqrt(np.einsum("ij,ij->i", q, q)) * np.sqrt(np.einsum("ij,ij->i", e, e)))


def best_of(scores: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the `top` best by exact score, then id; `scores` are right to 1e-9."""
    at = np.arange(len(scores))
    if len(scores) > top:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - top)[len(scores) - top] - 1e-9)
    exact = _cosine(np.broadcast_to(q, (len(at), len(q))), x[at])
    order = np.lexsort((ids[at], -exact))[:top]
    return at[order], exact[order]


def fit(entries: DataFrame, n: int, dim: int, p: np.ndarray, every: int, top: int, goal: float) -> tuple[np.ndarray, int, float]:
    """The sample's sorted strings, the number of trees, and how many candidates are wanted."""
    spark = entries.sparkSession

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = keys(_vectors(batch.column("embedding"), dim), p)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in np.ascontiguousarray(k.T)], pa.binary())], ["k"])

    share = F.pmod(F.xxhash64("entry", F.lit("sample")), F.lit(1 << 40)) < F.lit(int(min(1.0, SAMPLE / max(1, n)) * (1 << 40)))
    some = entries.where(share).select("embedding").mapInArrow(strings, "k binary").collect()
    arrays = np.sort(np.frombuffer(b"".join(r[0] for r in some), np.uint64).reshape(-1, len(p)).T, axis=1)
    held = sorted(((r[0], list(r[1])) for r in entries.orderBy(F.xxhash64("entry"), "entry").limit(HELD).select("entry", "embedding").collect()), key=lambda r: r[0])
    if n <= top + 1 or not arrays.shape[1]:
        return arrays, 1, np.inf
    own, tried = np.array([r[0] for r in held], np.int64), choices(len(p))
    q = scaled(np.array([r[1] for r in held], np.float64))
    q /= np.sqrt((q * q).sum(1))[:, None]
    key = keys(q, p)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(tried), len(q), DEPTH + 1), np.int64)
        best = [np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0, len(tried)), np.int64)]  # scores, entries, shared bits
        for batch in batches:
            for part in (batch.slice(k, 2000) for k in range(0, len(batch), 2000)):
                x, ids = _vectors(part.column("embedding"), dim), part.column("entry").to_numpy()
                k, hist, most, bits = keys(x, p), np.zeros((len(q), DEPTH + 1), np.int64), np.zeros((len(q), len(x)), np.int64), []
                for t in range(len(p)):
                    same = shared_bits(key[t][:, None], k[t][None, :])
                    hist += np.bincount((same + np.arange(len(q))[:, None] * (DEPTH + 1)).ravel(), minlength=hist.size).reshape(hist.shape)
                    most = np.maximum(most, same)
                    if t + 1 in tried:
                        counts[tried.index(t + 1)] += hist
                        bits.append(most)
                scores = q @ (x / np.sqrt((x * x).sum(1))[:, None]).T
                scores[own[:, None] == ids[None, :]] = -9
                all_ = [np.concatenate([best[0], scores], 1), np.concatenate([best[1], np.broadcast_to(ids, scores.shape)], 1), np.concatenate([best[2], np.stack(bits, 2)], 1)]
                order = np.argsort(-all_[0], axis=1)[:, :top]
                best = [np.take_along_axis(c, order if c.ndim == 2 else order[:, :, None], 1) for c in all_]
        at = np.indices(counts.shape).reshape(3, -1)
        full = np.flatnonzero(counts.ravel())
        score = [s for own_ in best[0] for s in own_]
        rows = np.repeat(np.arange(len(q)), best[0].shape[1])
        none = pa.nulls(len(full), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*(pa.array(at[c][full]) for c in range(3)), pa.array(counts.ravel()[full]), pa.nulls(len(full), pa.float64()), none], ["choice", "query", "level", "n", "score", "bits"])
        m = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, -1)), pa.array(rows), pa.array(np.zeros(m, np.int64)), pa.array(np.zeros(m, np.int64)), pa.array(score, pa.float64()), pa.array(best[2].reshape(m, len(tried)).tolist(), pa.list_(pa.int64()))], ["choice", "query", "level", "n", "score", "bits"])

    seen = cut(entries.select("entry", "embedding").mapInArrow(look, "choice long, query long, level long, n long, score double, bits array<long>"))
    counts = np.zeros((len(tried), len(q), DEPTH + 1))
    for c, k, level, m in seen.where("choice >= 0").groupBy("choice", "query", "level").agg(F.sum("n")).collect():
        counts[c, k, level] = m
    counts = counts[:, :, ::-1].cumsum(2)[:, :, ::-1]  # rows that share at least so many bits
    near: list[list[list[int]]] = [[] for _ in q]
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    for k, bits in seen.where("choice < 0 AND score > -9").withColumn("r", rank).where(F.col("r") <= top).select("query", "bits").collect():
        near[k].append(bits)
    return arrays, *choose(n, every, key, arrays, counts, near, goal)


def _one_vector(rows: DataFrame) -> DataFrame:
    """rows (vec_id, embedding) without all but the smallest vector of each vec_id; plain repeats stay."""
    v = F.xxhash64("embedding")
    twice = cut(rows.groupBy("vec_id").agg(F.min(v).alias("low"), F.max(v).alias("high")).where("low != high").select("vec_id"))
    if twice.isEmpty():
        return rows
    return rows.join(twice, "vec_id", "left_anti").unionByName(rows.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding")))


def nearest(vectors: DataFrame, top: int = TOP, every: int = EVERY, trees: int = TREES, bucket: int = BUCKET, wanted: float | None = None, goal: float = GOAL) -> DataFrame:
    """query_id, rank, vec_id, score for each row whose vec_id is divisible by `every`.

    wanted: candidates in all trees, instead of the fit's."""
    spark = vectors.sparkSession
    v = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = keep_columns(vectors, "vec_id", "embedding").where(ok)
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = sizes["n"] if sizes else 1
    rows = _one_vector(rows.where(F.size("embedding") == dim)).withColumns({"h1": F.xxhash64(v), "h2": F.xxhash64(F.lit("second"), v)})
    # The smallest ids of each distinct vector, by way of salted parts.
    ids = rows.select("h1", "h2", "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")).distinct()
    for key in (["h1", "h2", "salt"], ["h1", "h2"]):
        ids = ids.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))).where(F.col("r") <= top + 1)
    ids = ids.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asks = rows.where(F.col("vec_id") % every == 0)
    asked = asks.select("h1", "h2", "vec_id").distinct()
    # An entry is named by its smallest id, which no other vector has.
    alike = rows.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.max((F.col("vec_id") % every == 0).cast("int")).alias("asks"))
    entries = cut(ids.join(alike, ["h1", "h2"]).select("h1", "h2", F.element_at("ids", 1).alias("entry"), "ids", "embedding", (F.col("asks") == 1).alias("asks")))
    n, p = entries.count(), planes(dim, trees)
    arrays, used, most = fit(entries, n, dim, p, every, top, goal)
    if wanted is not None:
        used, most = trees, wanted
    p, arrays = p[:used], arrays[:used]
    bucket = int(min(max(bucket, most / used / 2), max(bucket, LARGEST)))
    count, sample = max(1, -(-n // bucket)), arrays.shape[1]
    bounds = arrays[:, (np.arange(1, count) * sample // count).astype(int)] if sample else arrays[:, :0]
    held = spark.sparkContext.broadcast((p, arrays, bounds, most * sample / max(1, n)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, arrays, bounds, wanted = held.value
        for batch in (b.slice(k, 4000) for b in batches for k in range(0, len(b), 4000)):
            x = _vectors(batch.column("embedding"), dim)
            k, entry, asks = keys(x, p), batch.column("entry").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            q = np.flatnonzero(asks)
            level = levels(k[:, q], arrays, wanted) if np.isfinite(wanted) else np.zeros(len(q), np.int64)
            for t in range(len(p)):
                # A string that is several bounds is dealt to the buckets between them.
                a, b = np.searchsorted(bounds[t], k[t], "left"), np.searchsorted(bounds[t], k[t], "right")
                own = np.where(b > a, a + (entry.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % (b - a + 1), a)
                out.append((np.full(len(x), t), own, np.zeros(len(x), int), k[t], k[t], np.arange(len(x))))
                low, high = prefix_range(k[t, q], level)
                first, last = np.searchsorted(bounds[t], low, "left"), np.searchsorted(bounds[t], high, "right")
                times = last - first + 1
                at = np.repeat(np.arange(len(q)), times)
                to = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                out.append((np.full(len(at), t), to, np.ones(len(at), int), low[at], high[at], q[at]))
            tree, to, kind, low, high, row = (np.concatenate(c) for c in zip(*out, strict=True))
            data = pa.array([e.tobytes() for e in x], pa.binary()).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(to.astype(np.int64)), pa.array(kind.astype(np.int32)), pa.array(_signed(low)), pa.array(_signed(high)), pa.array(entry[row]), data], ["tree", "bucket", "kind", "low", "high", "entry", "vector"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, ready = None, [], None
        for batch in batches:
            group = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("tree", "bucket", "kind")], 1)
            low, high, entry = (batch.column(c).to_numpy() for c in ("low", "high", "entry"))
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float64).reshape(-1, dim)
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1).tolist(), len(group)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if (now := tuple(group[a, :2].tolist())) != at:
                    at, parts, ready = now, [], None
                if group[a, 2] == 0:
                    parts.append((low[a:b], entry[a:b], x[a:b]))
                    ready = None
                    continue
                if not parts:
                    continue
                if ready is None:
                    own, ids, vectors = (np.concatenate(c) for c in zip(*parts, strict=True))
                    order = np.argsort(own, kind="stable")
                    own, ids, vectors = own[order], ids[order], vectors[order]
                    ready = own, ids, vectors, vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
                own, ids, vectors, unit = ready
                s, e = np.searchsorted(own, low[a:b], "left"), np.searchsorted(own, high[a:b], "right")
                size = np.sqrt(np.einsum("ij,ij->i", x[a:b], x[a:b]))
                found: list[tuple] = []
                whole = (s == 0) & (e == len(own))
                for some in np.array_split(np.flatnonzero(whole), 1 + whole.sum() * len(own) // 4_000_000):  # these in one product
                    for i, score in zip(some.tolist(), (x[a:b][some] / size[some][:, None]) @ unit.T, strict=True):
                        place_, exact = best_of(score, x[a + i], vectors, ids, top + 1)
                        found += [(int(entry[a + i]), int(ids[k]), v) for k, v in zip(place_.tolist(), exact.tolist(), strict=True)]
                for i in np.flatnonzero(~whole & (e > s)).tolist():
                    part = slice(s[i], e[i])
                    place_, exact = best_of(unit[part] @ (x[a + i] / size[i]), x[a + i], vectors[part], ids[part], top + 1)
                    found += [(int(entry[a + i]), int(ids[part][k]), v) for k, v in zip(place_.tolist(), exact.tolist(), strict=True)]
                if found:
                    q, c, v = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(v, pa.float64())], ["query", "entry", "score"])

    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = entries.select("entry", "embedding", "asks").mapInArrow(place, "tree int, bucket long, kind int, low long, high long, entry long, vector binary")
    near = placed.repartition(shuffles, "tree", "bucket").sortWithinPartitions("tree", "bucket", "kind").mapInArrow(search, "query long, entry long, score double").distinct()
    rank = lambda name: F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), name))
    near = near.withColumn("r", rank("entry")).where(F.col("r") <= top + 1)
    near = near.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    best = near.withColumn("r", rank("vec_id")).where(F.col("r") <= top + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    best = best.join(entries.select(F.col("entry").alias("query"), "h1", "h2"), "query").select("h1", "h2", "best")
    answers = asked.withColumnRenamed("vec_id", "query_id").join(best, ["h1", "h2"])
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, top)
    return answers.select("query_id", F.posexplode(others).alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
