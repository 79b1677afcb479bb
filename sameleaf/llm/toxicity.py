"""Op 5: toxicity by a weighted finite-state grammar over clauses.

A text is cut into clauses, and each word is read as a symbol: an insult or a threat (with a strength in
steps of STEP), a target (whom it is about), a negation, a report (speech that is only quoted), or any
other word. Strengths of insults come from a learned lexicon of words and word beginnings with their
log odds; threats, targets, negations and reports are small lists for English, German, French and
Spanish. Five transducers are composed to one (see compose):
  insult    rewrites an insult to a hit with two strengths: plain, and aimed at someone;
  threat    does so for threats, which alone are as strong as the lexicon says, and aimed THREAT at least;
  negation  weakens hits up to REACH words after a negation;
  report    weakens hits in the rest of a clause after a word that reports speech;
  target    weighs each hit: as aimed if a target stands up to REACH words before it or, by a guess that
            a later target has to confirm, after it; otherwise as plain.
A clause's score is that of the best path through the composed machine (weights add, the largest sum
wins), so a lone word's match is the least of them. A logistic function of the best clause, the sum and
the number of matching clauses gives the document's score.

The lexicon and the logistic function are learned from labels of rows outside the held-out fold (crc32
of doc_id as text, mod FOLDS, isn't 0): at most SAMPLE toxic and SAMPLE other labelled documents, those
with the smallest hash of doc_id. Documents that share the smallest hash of their word pairs, as copies
do, count once for the lexicon, so a copied text doesn't teach its other words. Scoring goes over whole
texts of all rows, in bounded memory, without a shuffle.

Defined results: null and empty texts have no matches and get the score of such texts. Labels that are
null, or of documents that aren't there, teach nothing; of several labels of one doc_id the largest
counts. A null doc_id counts as the empty string for the fold. Without toxic labels nothing is learned
and all scores are 0. Repeated rows are scored each. At most LEXICON entries, those of the largest odds,
make the lexicon. Empty input gives empty output.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, keep_columns, table

FOLDS, SAMPLE, LEXICON, LEAST, ODDS, CACHE = 5, 10_000, 50_000, 5, 3.0, 400_000
BEGINNINGS = (4, 5, 6, 7)
EDGE = "\"'.,;:!?()[]{}<>*#%$&-–—…«»“”„‘’¿¡|/\\"
ENDS = ".,;:!?…"
THREATS = frozenset("kill hurt destroy murder beat stab shoot burn töten umbringen verletzen tuer frapper blesser matar herir golpear".split())
TARGETS = frozenset("you your you're yours they them their he him she her this these those people everyone du dich dir euch ihr sie tu te toi vous vos ils elles tú ti usted ustedes ellos ellas".split())
NEGATIONS = frozenset("not no never isn't aren't don't doesn't wasn't nicht kein keine nie pas jamais nunca ningún".split())
REPORTS = frozenset("said says wrote writes quoted claimed called sagte sagt schrieb dit disait écrit dijo dice escribió".split())
REACH, NEGATED, REPORTED, TARGETED, THREAT, STEP, STRONGEST = 3, 0.4, 0.6, 1.5, 3.0, 0.25, 8.0


def core(token: str) -> str:
    return token.strip(EDGE).lower()


def traits(word: str) -> list[str]:
    """What the lexicon may know of a word: itself, and the beginnings of longer words."""
    return [word, *(f"{word[:k]}~" for k in BEGINNINGS if len(word) > k)]


def tokens(text: str | None) -> list[str]:
    return (text or "").split()


# ---- transducers
#
# Symbols are tuples: ("o",) any word, ("t",) target, ("n",) negation, ("r",) report, ("i", k) an insult
# and ("k", k) a threat of k steps, and between transducers ("h", plain, aimed), a hit.

OTHER, TARGET, NEGATION, REPORT = ("o",), ("t",), ("n",), ("r",)
PLAIN_SYMBOLS = (OTHER, TARGET, NEGATION, REPORT)


@dataclass
class Transducer:
    """Arcs from a state by an input symbol: (output symbol, weight, next state). State 0 is the first."""

    arcs: dict[int, dict[tuple, list[tuple[tuple, int, int]]]] = field(default_factory=dict)
    final: set[int] = field(default_factory=set)

    def add(self, state: int, symbol: tuple, out: tuple, weight: int, to: int) -> None:
        self.arcs.setdefault(state, {}).setdefault(symbol, []).append((out, weight, to))

    def symbols(self) -> set[tuple]:
        return {s for own in self.arcs.values() for s in own}

    def outputs(self) -> set[tuple]:
        return {out for own in self.arcs.values() for arcs in own.values() for out, _, _ in arcs}


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that does what the second makes of the first's output; weights add."""
    out, number, todo = Transducer(), {(0, 0): 0}, [(0, 0)]
    while todo:
        a, b = pair = todo.pop()
        if a in first.final and b in second.final:
            out.final.add(number[pair])
        for symbol, arcs in first.arcs.get(a, {}).items():
            for between, w, to in arcs:
                for after, v, then in second.arcs.get(b, {}).get(between, ()):
                    if (to, then) not in number:
                        number[to, then] = len(number)
                        todo.append((to, then))
                    out.add(number[pair], symbol, after, w + v, number[to, then])
    return out


def best_path(machine: Transducer, symbols: list[tuple]) -> int | None:
    """The largest weight of a path that reads the symbols and ends in a final state."""
    now = {0: 0}
    for s in symbols:
        then: dict[int, int] = {}
        for state, sum_ in now.items():
            for _, w, to in machine.arcs.get(state, {}).get(s, ()):
                if sum_ + w > then.get(to, -1):
                    then[to] = sum_ + w
        now = then
    return max((w for state, w in now.items() if state in machine.final), default=None)


def _one_state(rewrite: dict[tuple, tuple]) -> Transducer:
    t = Transducer(final={0})
    for symbol, out in rewrite.items():
        t.add(0, symbol, out, 0, 0)
    return t


def _weaker(symbol: tuple, by: float) -> tuple:
    return ("h", int(symbol[1] * by + 0.5), int(symbol[2] * by + 0.5)) if symbol[0] == "h" else symbol


def insult_transducer(steps: int) -> Transducer:
    same = [*PLAIN_SYMBOLS, *(("k", k) for k in range(steps + 1))]
    return _one_state({**{x: x for x in same}, **{("i", k): ("h", k, int(k * TARGETED + 0.5)) for k in range(1, steps + 1)}})


def threat_transducer(before: Transducer, steps: int) -> Transducer:
    least = int(THREAT / STEP)
    keep = {x: x for x in before.outputs() if x[0] != "k"}
    return _one_state({**keep, **{("k", k): ("h", k, max(least, int(k * TARGETED + 0.5))) for k in range(steps + 1)}})


def negation_transducer(symbols: set[tuple]) -> Transducer:
    """State k: that many words of a negation's reach are left."""
    t = Transducer(final=set(range(REACH + 1)))
    for state in range(REACH + 1):
        for x in symbols:
            t.add(state, x, OTHER if x == NEGATION else _weaker(x, NEGATED) if state else x, 0, REACH if x == NEGATION else max(0, state - 1))
    return t


def report_transducer(symbols: set[tuple]) -> Transducer:
    t = Transducer(final={0, 1})
    for state in (0, 1):
        for x in symbols:
            t.add(state, x, OTHER if x == REPORT else _weaker(x, REPORTED) if state else x, 0, int(state or x == REPORT))
    return t


def target_transducer(symbols: set[tuple]) -> Transducer:
    """State (r, g): r words of a target's reach are left; g words are left in which a guessed target has to come (0: none is guessed)."""
    number = {(r, g): r * (REACH + 1) + g for r in range(REACH + 1) for g in range(REACH + 1)}
    t = Transducer(final={n for (_, g), n in number.items() if not g})
    for (r, g), n in number.items():
        for x in symbols:
            if x == TARGET:
                t.add(n, x, OTHER, 0, number[REACH, 0])
                continue
            if g == 1:
                continue  # the guess was wrong
            left = max(0, r - 1), max(0, g - 1)
            if x[0] != "h":
                t.add(n, x, OTHER, 0, number[left])
            elif r:
                t.add(n, x, OTHER, x[2], number[left])
            else:
                t.add(n, x, OTHER, x[1], number[left])
                if x[2] > x[1]:
                    t.add(n, x, OTHER, x[2], number[left[0], left[1] or REACH])
    return t


def parts(steps: int = int(STRONGEST / STEP)) -> list[Transducer]:
    """The five transducers, each over the symbols that the one before puts out."""
    out = [insult_transducer(steps)]
    out.append(threat_transducer(out[-1], steps))
    for make in (negation_transducer, report_transducer, target_transducer):
        out.append(make(out[-1].outputs()))
    return out


@lru_cache(maxsize=1)
def machine() -> Transducer:
    return reduce(compose, parts())


class Grammar:
    """Reads texts by the composed machine. A token is read as (symbol, ends a clause)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.read, self.machine = lexicon, {}, machine()

    def of(self, token: str) -> tuple[tuple, bool]:
        got = self.read.get(token)
        if got is None:
            if len(self.read) > CACHE:
                self.read.clear()
            word = core(token)
            weight = max((self.lexicon.get(x, 0.0) for x in traits(word)), default=0.0) if word else 0.0
            k = int(min(weight, STRONGEST) / STEP + 0.5)
            symbol = ("k", k) if word in THREATS else ("i", k) if k else TARGET if word in TARGETS else NEGATION if word in NEGATIONS else REPORT if word in REPORTS else OTHER
            got = self.read[token] = (symbol, token[-1] in ENDS)
        return got

    def matches(self, text: str | None) -> list[float]:
        """The score of each clause that has any."""
        read = [self.of(x) for x in tokens(text)]
        hits = [i for i, (x, _) in enumerate(read) if x[0] in "ik"]
        out, done = [], 0
        for hit in hits:
            if hit < done:
                continue
            start = hit
            while start > done and not read[start - 1][1]:
                start -= 1
            done = hit
            while done < len(read) - 1 and not read[done][1]:
                done += 1
            done += 1
            score = best_path(self.machine, [x for x, _ in read[start:done]])
            if score:
                out.append(score * STEP)
        return out

    def features(self, text: str | None) -> tuple[float, float, float]:
        found = self.matches(text)
        return min(max(found, default=0.0), 12.0) / 6, math.log1p(sum(found)), math.log1p(len(found))


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a logistic function, by Newton's method with a small penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


def _fold(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], np.ndarray] | None:
    """The lexicon and the logistic weights, or None where there is nothing to learn from."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    known = keep_columns(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sides = [known.where((F.col("toxic") > 0) == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for side in (True, False)]
    some = sides[0].unionByName(sides[1])
    texts = cut(keep_columns(docs, "doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", (F.col("toxic") > 0).alias("toxic")))  # at most 2 * sample ids

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                w = [core(x) for x in tokens(text)]
                out.append(min((xxhash.xxh64_intdigest(f"{a} {b}") >> 1 for a, b in zip(w, w[1:], strict=False)), default=0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(out, pa.int64())], ["doc_id", "toxic", "key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    single = texts.mapInArrow(keys, f"doc_id {kind}, toxic boolean, key long").groupBy("key", "toxic").agg(F.min("doc_id").alias("doc_id"))
    single = cut(single.select("doc_id", "toxic"))
    totals = {r["toxic"]: r["count"] for r in single.groupBy("toxic").count().collect()}
    pos, neg = totals.get(True, 0), totals.get(False, 0)
    if not pos or not neg:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = {core(x) for x in tokens(text)} - {""}
                for t in {t for w in words for t in traits(w)}:
                    seen.setdefault(t, [0, 0])[not toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([c[k] for c in seen.values()], pa.int64()) for k in (0, 1))], ["trait", "pos", "neg"])

    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    counted = texts.join(F.broadcast(single.select("doc_id")), "doc_id", "left_semi").mapInArrow(count, "trait string, pos long, neg long")
    counted = counted.groupBy("trait").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    least = max(LEAST, math.ceil(0.001 * pos))
    words = counted.where((F.col("pos") >= least) & (F.col("neg") * 20 <= F.col("pos"))).select("trait", odds.alias("odds")).where(F.col("odds") >= ODDS).orderBy(F.desc("odds"), "trait").limit(LEXICON)
    lexicon = {r["trait"]: min(r["odds"], STRONGEST) for r in words.collect()}
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(held.value)
        for batch in batches:
            x = np.array([grammar.features(t) for t in batch.column("text").to_pylist()], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(x[:, k]) for k in range(3))], ["toxic", "a", "b", "c"])

    rows = np.array([tuple(r) for r in texts.mapInArrow(measure, "toxic boolean, a double, b double, c double").collect()], float).reshape(-1, 4)
    return lexicon, fit(rows[:, 1:], rows[:, 0])


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))
    docs = keep_columns(docs, "doc_id", "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, w = model.value or ({}, None)
        grammar = Grammar(lexicon)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = [0.0 if w is None else 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(w[:3], grammar.features(t)) + w[3]))))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_fold(x) == 0 for x in ids], pa.bool_()), pa.array(out, pa.float64()), pa.array([int(x >= 0.5) for x in out], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
