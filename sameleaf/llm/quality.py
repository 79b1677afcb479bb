"""Op 3: a quality classifier from weak labels.

Heuristic labellers look at whole texts and say good, bad or nothing. Each takes another view of the
same thing, running prose: plain words, pairs of plain and different words, plain trigrams and bigrams
that are new, neighbours that differ, few signs, sentences of such words, few capitals. So a bad text
has several of them against it, whatever its flaw, and they err each in its own way.
Expectation-maximisation over the counted vote patterns (at most 3 ^ labellers rows at any input
size, counted over all documents) estimates how often each labeller says what for either class, and
gives each pattern its posterior. The class that most labellers call bad more often than the other is
the bad one; no bound is set to their rates. A linear scorer on hashed word shapes and binned statistics
learns the posteriors; it, not the votes, decides, so it also judges texts that the labellers are silent
on. It is fitted on a bounded sample: at most SAMPLE documents on either side of the posterior, those
with the smallest hash of doc_id.

Texts are scanned once; the table of features (a few hundred bytes a document) is kept in the shared
folder, and fitting and scoring read it. keep_quality() knows a row by its doc_id and two hashes of its
text, and takes those out that the table's scores reject.

Defined results: texts without words, null ones included, score 0 and aren't kept. Repeated rows are
scored each. Where the labellers call no class bad at least LEAST of the time, there is no bad class.
With no document on one side of the posterior the scorer says the other side for all. Ties don't occur,
as a score of 0.5 is kept. Empty input gives empty output. The labels table isn't used.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEPT, cut, keep_columns, lean, table

DIM, SAMPLE, CACHE, STEPS, ROUNDS, LEAST = 1024, 4000, 400_000, 400, 200, 0.2
LABELLERS = ("plain", "pairs", "trigrams", "bigrams", "neighbours", "signs", "sentences", "capitals")
STATISTICS = (*LABELLERS, "length")
BAD, GOOD, SILENT = 0, 1, 2
SIGN, CAPITAL, PLAIN, STOP = 1, 2, 4, 8
ODD = re.compile(r"[#$%&*~^<>{}=\\|_@]|!!$")
EDGE, ENDS = ".,;:!?…\"'()[]«»“”„‘’¿¡-–—", ".?!。！？…"
RUNS = ((re.compile(r"[^\W\d_]*[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ]+"), "U"), (re.compile(r"[A-ZÀ-ÖØ-Þ]"), "X"), (re.compile(r"[^\W\d_UX]+"), "x"), (re.compile(r"\d+"), "9"))


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % DIM


def shape(word: str) -> str:
    for pattern, sign in RUNS:
        word = pattern.sub(sign, word)
    return word[:12]


class Known(dict):
    """A word's bucket and flags, kept for words met before."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        core = word.strip(EDGE)
        letters = core.replace("'", "").replace("’", "").replace("-", "")
        plain = letters.isalpha() and len(word) - len(core) <= 3 and core[1:] == core[1:].lower()
        flags = SIGN * bool(ODD.search(word)) | CAPITAL * (len(word) > 1 and word.isupper()) | PLAIN * plain | STOP * (word.rstrip("\"'”»)")[-1:] in ENDS if word.rstrip("\"'”»)") else False)
        out = self[word] = flags << 16 | _bucket("s:" + shape(word))
        return out


_KNOWN = Known()
KEPT["quality"] = _KNOWN.clear


def _new(h: np.ndarray, k: int, ok: np.ndarray | None = None) -> float:
    """The share of runs of k words that are different ones (and, if given, ok)."""
    m = len(h) - k + 1
    if m < 1:
        return 1.0
    x = h[:m].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            x = (x * np.uint64(0x9E3779B97F4A7C15) ^ h[i : i + m]) * np.uint64(0xBF58476D1CE4E5B9)
    return len(np.unique(x if ok is None else x[ok])) / m


def statistics(text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of words, STATISTICS, and the words' buckets."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return 0, np.zeros(len(STATISTICS)), np.zeros(0, np.int64)
    codes = np.fromiter(map(_KNOWN.__getitem__, words), np.int64, n)
    flags = codes >> 16
    plain, stop = flags & PLAIN > 0, flags & STOP > 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    same = h[1:] == h[:-1]
    pairs = plain[1:] & plain[:-1] & ~same
    # Sentences: 3 to 80 words that are plain, nine in ten, with pairs for neighbours.
    sentence = np.cumsum(np.append(False, stop[:-1]))
    size = np.bincount(sentence)
    fine = (np.bincount(sentence, plain) >= 0.9 * size) & (np.bincount(sentence[1:], pairs, len(size)) >= 0.8 * (size - 1)) & (size >= 3) & (size <= 80)
    share = [
        plain.mean(), pairs.mean() if n > 1 else 1.0, _new(h, 3, plain[2:] & plain[1:-1] & plain[:-2]), _new(h, 2), same.mean() if n > 1 else 0.0,
        np.count_nonzero(flags & SIGN) / n, size[fine].sum() / n, np.count_nonzero(flags & CAPITAL) / n, len(text) / n,
    ]
    return n, np.array(share), codes & 0xFFFF


def votes(n: int, s: np.ndarray) -> str:
    def say(bad: bool, good: bool) -> str:
        return str(BAD if bad else GOOD if good else SILENT)

    if not n:
        return str(SILENT) * len(LABELLERS)
    some = n >= 20
    return "".join((
        say(s[0] < 0.7, s[0] > 0.9), say(n >= 5 and s[1] < 0.5, n >= 5 and s[1] > 0.8), say(some and s[2] < 0.5, some and s[2] > 0.8), say(some and s[3] < 0.5, some and s[3] > 0.8),
        say(n >= 8 and s[4] > 0.2, n >= 8 and s[4] < 0.05), say(s[5] > 0.2, s[5] < 0.05), say(n >= 40 and s[6] < 0.2, n >= 8 and s[6] > 0.5), say(s[7] > 0.5, s[7] < 0.2),
    ))


def features(n: int, s: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: the share of each shape, and a one for each binned statistic."""
    counts = np.bincount(buckets, minlength=DIM) / max(1, n)
    for name, x, scale in zip(STATISTICS, s, (10, 10, 10, 10, 10, 10, 10, 10, 0.5), strict=True):
        counts[_bucket(f"{name}:{min(10, int(x * scale))}")] += 0.3 * min(1, n / 20)  # shares of few words say little
    counts[_bucket(f"n:{min(8, n.bit_length())}")] += 0.1
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at].astype(np.float32)


def fit_labellers(patterns: dict[str, int]) -> tuple[dict[str, float], np.ndarray]:
    """The posterior of "good" for each vote pattern, and how often labellers say bad when they speak: (bad and good class, labeller).

    Expectation-maximisation for two classes in which labellers err independently. Silence says nothing.
    """
    names = sorted(patterns)
    width = len(names[0]) if names else len(LABELLERS)
    v = np.array([[int(c) for c in x] for x in names], np.int64).reshape(len(names), width)
    count = np.array([patterns[x] for x in names], float)
    bad, good = (v == BAD).astype(float), (v == GOOD).astype(float)
    rate = (count @ bad + 0.5) / (count @ (bad + good) + 1)
    prior, says = np.array([0.1, 0.9]), np.stack([np.maximum(0.3, rate), rate / 2])
    posterior = np.zeros((len(names), 2))
    for _ in range(ROUNDS):
        joint = np.log(prior) + bad @ np.log(says.T) + good @ np.log1p(-says.T)
        posterior = np.exp(joint - joint.max(1, keepdims=True)) if len(names) else joint
        posterior /= posterior.sum(1, keepdims=True)
        weight = posterior * count[:, None]
        new = (weight.T @ bad + [[0.5], [0.01]]) / (weight.T @ (bad + good) + 1)  # as if each had said one thing before
        prior = (weight.sum(0) + 1) / (count.sum() + 2)
        moved, says = np.abs(new - says).max(), new
        if moved < 1e-7:
            break
    if 2 * (says[0] > says[1]).sum() < width:
        says, posterior = says[::-1], posterior[:, ::-1]
    if says[0].mean() < LEAST:
        posterior = np.tile([0.0, 1.0], (len(names), 1))
    return dict(zip(names, posterior[:, 1].tolist(), strict=True)), says


def fit_scorer(rows: list[tuple], steps: int = STEPS) -> np.ndarray:
    """Weights and a bias from (buckets, values, posterior), by accelerated gradient descent.

    The good side weighs three times the other, as a good document lost is worse than a bad one kept."""
    y = np.array([r[2] for r in rows])
    if not len(y) or y.min() > 0.5 or y.max() <= 0.5:
        return np.append(np.zeros(DIM), 5.0 if not len(y) or y.min() > 0.5 else -5.0)
    x = np.zeros((len(rows), DIM + 1), np.float32)
    x[:, DIM] = 1
    for k, (at, value, _) in enumerate(rows):
        x[k, at] = value
    weight = np.where(y > 0.5, 0.75 / (y > 0.5).sum(), 0.25 / (y <= 0.5).sum())
    w = z = np.zeros(DIM + 1)
    rate = 1 / (0.25 * float((x * x).sum(1).max()) + 1e-5)
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ z.astype(np.float32), -30, 30)))
        new = z - rate * (x.T @ ((p - y) * weight).astype(np.float32) + 1e-5 * z)
        z, w = new + (k - 1) / (k + 2) * (new - w), new
    return w


def _score(w: np.ndarray, n: int, at: np.ndarray, value: np.ndarray) -> float:
    return 1 / (1 + float(np.exp(-np.clip(w[at] @ value + w[DIM], -30, 30)))) if n else 0.0


def known(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return keep_columns(docs, "doc_id", "text").select("doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"), "text")


class Model:
    def __init__(self, docs: DataFrame, sample: int = SAMPLE):
        kind = docs.schema["doc_id"].dataType.simpleString()

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, pattern, at, value = [], [], [], []
                for text in batch.column("text").to_pylist():
                    words, s, buckets = statistics(text)
                    a, v = features(words, s, buckets)
                    n.append(words)
                    pattern.append(votes(words, s))
                    at.append(a)
                    value.append(v)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h1", "h2")), pa.array(n, pa.int64()), pa.array(pattern, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["doc_id", "h1", "h2", "n", "votes", "at", "value"])

        self.table = cut(known(docs).mapInArrow(lean(look, "quality"), f"doc_id {kind}, h1 long, h2 long, n long, votes string, at array<int>, value array<float>"))
        self.posterior, self.says = fit_labellers({r["votes"]: r["count"] for r in self.table.groupBy("votes").count().collect()})
        good = [x for x, p in self.posterior.items() if p > 0.5]
        h = F.xxhash64("doc_id").alias("h")
        sides = [self.table.where(side & (F.col("n") > 0)).select("at", "value", "votes", h).orderBy("h", "votes").limit(sample) for side in (F.col("votes").isin(good), ~F.col("votes").isin(good))]
        posterior = self.posterior

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = sorted((h, v, a, x) for b in batches for h, v, a, x in zip(*(b.column(c).to_pylist() for c in ("h", "votes", "at", "value")), strict=True))
            w = fit_scorer([(np.array(a), np.array(x, np.float32), posterior[v]) for _, v, a, x in rows])
            yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64()))], ["weights"])

        # At most 2 * sample rows come to this task; the driver gets the weights alone.
        fitted = sides[0].unionByName(sides[1]).coalesce(1).mapInArrow(lean(fit, "quality"), "weights array<double>").first()
        self.weights = np.array(fitted["weights"]) if fitted else fit_scorer([])

    def scores(self) -> DataFrame:
        """doc_id, score, kept, weak (the posterior), votes of each row."""
        return self._scored().select("doc_id", "score", "kept", "weak", "votes")

    def _scored(self) -> DataFrame:
        held = self.table.sparkSession.sparkContext.broadcast((self.weights, self.posterior))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, posterior = held.value
            for batch in batches:
                out = [_score(w, n, np.array(a, np.int64), np.array(v)) for n, a, v in zip(*(batch.column(c).to_pylist() for c in ("n", "at", "value")), strict=True)]
                weak = [posterior[x] for x in batch.column("votes").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h1", "h2")), pa.array(out, pa.float64()), pa.array([x >= 0.5 for x in out], pa.bool_()), pa.array(weak, pa.float64()), batch.column("votes")], ["doc_id", "h1", "h2", "score", "kept", "weak", "votes"])

        return self.table.mapInArrow(lean(score, "quality"), f"doc_id {self.table.schema['doc_id'].dataType.simpleString()}, h1 long, h2 long, score double, kept boolean, weak double, votes string")

    def keep(self, docs: DataFrame) -> DataFrame:
        """The rows of docs that the scorer keeps, with all their columns."""
        gone = cut(self._scored().where("NOT kept").select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "h1", "h2")]).distinct())
        text = F.coalesce("text", F.lit(""))
        same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.xxhash64(text) == F.col("__h1")) & (F.xxhash64(F.lit("second"), text) == F.col("__h2"))
        return docs.join(gone, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_quality(docs: DataFrame) -> DataFrame:
    return Model(docs).keep(docs)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Model(table(spark, sf_dir, "documents")).scores()
