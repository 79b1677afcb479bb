"""Each operator against brute force, on fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sameleaf.llm import chat_format, decontamination, line_dedup, near_duplicates, nearest, packing, quality, secrets, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(1)
SYLLABLES = ["ta", "ri", "mo", "le", "nu", "ka", "so", "vi"]


def word(r=R):
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))


def prose(n, r=R):
    return " ".join(word(r) for _ in range(n))


def docs(spark, texts, *more):
    """Documents with the texts, and further columns whose names operators use inside."""
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, *more], DOCS)
    for c in ("size", "unit", "n", "id", "row", "bucket", "__hits", "n_lines", "w", "f1"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark, ddl=DOCS):
    return spark.createDataFrame([], ddl)


# ---- 1


def lines_by_hand(texts, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    count = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if count[key(x)] < least or not key(x)]
        out.append((len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_line_dedup(spark, broadcast):
    texts = [f"Shared  LINE\t\n{prose(4)}\n É {'x' * (k % 3)}" for k in range(12)] + [None, "", "\n\n", "shared  line", "long\n" * 3000 + "end", "a\n\x0b shared  line \r"]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.drop_shared_lines(docs(spark, texts), min_docs=4, broadcast_bytes=broadcast).collect()}
    assert [got[k] for k in range(len(texts))] == lines_by_hand(texts, 4)
    assert line_dedup.drop_shared_lines(empty(spark), broadcast_bytes=broadcast).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 5000, dtype=np.int64))
    made = line_dedup.PerfectHash(line_dedup.PerfectHash.build(keys))
    assert sorted(made.slots(keys)) == list(range(len(keys)))


def test_keys_that_share_their_first_hash():
    r = np.random.default_rng(2)
    h = r.integers(-(1 << 63), (1 << 63) - 1, (500, 2), dtype=np.int64)
    h[10:13, 0] = h[9, 0]
    n = np.arange(500) + 10
    shard = line_dedup.Shard(line_dedup.pack_shard(0, h[:, 0], h[:, 1], n))
    assert shard.count(h).tolist() == n.tolist()
    assert not shard.count(np.stack([h[:, 0], h[:, 1] + 1], 1)).any()


# ---- 2


def components_by_hand(texts, width, num=80):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    return [(len(s), c) for s, c in zip(sets, comp, strict=True)]


def near_texts():
    r = random.Random(2)
    texts = [None, "", " \n", "one two", "ONE  two", "three"]
    for base in range(6):
        words = prose(60, r).split()
        for _ in range(12):
            own = list(words)
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = word(r)
            texts.append(" ".join(own))
            words = own if base % 2 else words  # chains, and stars
    return texts + [texts[-1]] * 20 + [prose(30_000, r)]


@pytest.mark.parametrize("block, visits", [(512, 16), (8, 0)])
def test_near_duplicates(spark, block, visits, monkeypatch):
    monkeypatch.setattr(near_duplicates, "VISITS", visits)  # 0: with turns of representatives
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates.link_components(docs(spark, texts), 4, block=block).where("doc_id IS NOT NULL").collect()}
    assert [got[k] for k in range(len(texts))] == [(n, c, c == k) for k, (n, c) in enumerate(components_by_hand(texts, 4))]


def test_rows_of_one_doc_id_are_one_node(spark):
    made = spark.createDataFrame([(5, "a"), (5, "b"), (7, "a x"), (8, "b y"), (9, "a"), (5, "a"), (8, "B  y")], "doc_id long, text string")
    long = {"a": " ".join("abcdefghij"), "b": " ".join("klmnopqrst"), "a x": " ".join("abcdefghij") + " x", "b y": " ".join("klmnopqrst") + " y", "B  y": " ".join("KLMNOPQRST") + "  y"}
    rows = made.replace(long, subset="text")
    got = {(r.doc_id, r.component_id) for r in near_duplicates.link_components(rows, 4).collect()}
    assert got == {(5, 5), (7, 5), (8, 5), (9, 5)}
    kept = near_duplicates.keep_one_of_each(rows.withColumn("n", F.lit(1)), 4)
    assert kept.columns == ["doc_id", "text", "n"] and [r.doc_id for r in kept.collect()] == [5]
    r = random.Random(21)
    texts = near_texts()
    ids = [r.randrange(40) for _ in texts]
    parts = components_by_hand(texts, 4)
    comp = {i: i for i in ids}
    for (n, c), i in zip(parts, ids, strict=True):
        if n:
            low, high = sorted((comp[i], comp[ids[c]]))
            comp = {k: low if v == high else v for k, v in comp.items()}
    rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {(x.doc_id, x.component_id) for x in near_duplicates.link_components(rows, 4, block=8).where("n_shingles > 0").collect()}
    assert got == {(i, comp[i]) for (n, _), i in zip(parts, ids, strict=True) if n}


def test_visitors_meet_residents_only():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 40, 30).astype(np.uint64)) for _ in range(40)]
    visits = r.random(40) < 0.5
    i, j = near_duplicates.linked(sets, visits, 50, 100)
    wanted = {(a, b) for a in range(40) for b in range(a + 1, 40) if not (visits[a] and visits[b]) and 100 * len(np.intersect1d(sets[a], sets[b])) >= 50 * len(np.union1d(sets[a], sets[b]))}
    assert wanted and set(zip(i.tolist(), j.tolist(), strict=True)) == wanted


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates.link_components(empty(spark)).count() == 0
    rows = near_duplicates.link_components(docs(spark, ["a b c d e f"], (None, "a b c d e f", None, None, None), (0, "a b c d e f", None, None, None)), 4).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in rows if r.doc_id is not None) == [(False, 0, True)] * 2
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]


def test_sketch_estimates_similarity():
    r = np.random.default_rng(4)
    same = [(near_duplicates.sketch(np.unique(np.append(a, b[:25]))) == near_duplicates.sketch(np.unique(np.append(a, b[25:])))).mean() for a, b in ((r.integers(0, 1 << 62, 100, dtype=np.uint64), r.integers(0, 1 << 62, 50, dtype=np.uint64)) for _ in range(40))]
    assert abs(np.mean(same) - 100 / 150) < 0.03
    assert near_duplicates.sketch(np.array([5], np.uint64)).all()


# ---- 3


def junk_and_prose(n=150):
    r, out = random.Random(6), []
    for k in range(n):
        w = prose(60, r).capitalize().split()
        kind = k % 10
        clean = ". ".join(" ".join(w[i : i + 8]).capitalize() for i in range(0, 60, 8)) + "."
        out.append({0: " ".join(x + "%%%" for x in w), 1: " ".join(x.upper() + "!!" for x in w[:12] * 5), 2: " | ".join(w), 3: " ".join(x for x in w[:5] for _ in range(12))}.get(kind, clean))
    return out


def test_quality(spark):
    texts = junk_and_prose() + [None, "", "   "]
    rows = {r.doc_id: r for r in quality.Model(docs(spark, texts)).scores().collect()}
    assert all(rows[k].kept == (k % 10 > 3) for k in range(150))
    assert all(rows[k].score == 0 and not rows[k].kept for k in range(150, 153))
    own = docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    kept = quality.keep_quality(own.union(own.where("doc_id IN (4, 5, 0)")))  # repeated rows stay and go together
    assert kept.where("doc_id IN (4, 5)").count() == 4
    assert kept.columns == own.columns and {r.doc_id for r in kept.collect()} == {k for k in range(150) if k % 10 > 3}


def plain_em(v, rounds=400):
    """Two classes, row by row, without patterns; v: 0 bad, 1 good, 2 silent."""
    bad, good = v == 0, v == 1
    q = np.where(bad.sum(1) * 2 > (bad | good).sum(1), 0.9, 0.1)  # by majority
    for _ in range(rounds):
        w = np.stack([q, 1 - q])
        says, prior = np.clip((w @ bad) / (w @ (bad | good)), 1e-9, 1 - 1e-9), w.mean(1)
        joint = np.log(prior)[:, None] + np.log(says) @ bad.T + np.log1p(-says) @ good.T
        q = 1 / (1 + np.exp(joint[1] - joint[0]))
    return q, says


@pytest.mark.parametrize("low, high, wrong, share", [(0.3, 0.6, 0.02, 0.15), (0.6, 0.9, 0.1, 0.3), (0.5, 0.8, 0.02, 0.6)])
def test_labellers_accuracies_are_found(low, high, wrong, share):
    r = np.random.default_rng(7)
    hit, y = np.linspace(low, high, 8), r.random(20_000) < share
    v = np.where(r.random((20_000, 8)) < np.where(y[:, None], hit, wrong), 0, 1)
    v[r.random(v.shape) < 0.1] = 2
    names = ["".join(map(str, x)) for x in v.tolist()]
    posterior, says = quality.fit_labellers(Counter(names))
    assert np.abs(says[0] - hit).max() < 0.03 and np.abs(says[1] - wrong).max() < 0.015  # as planted
    q, plain = plain_em(v)
    assert np.abs(says - plain).max() < 0.01
    assert np.abs(np.array([posterior[x] for x in names]) - (1 - q)).max() < 0.05
    assert quality.fit_labellers({"11111111": 900, "11111110": 20, "11111101": 20})[0]["11111110"] > 0.9  # nothing that labellers agree is bad


def test_quality_of_nothing(spark):
    model = quality.Model(empty(spark))
    assert model.scores().count() == 0 and model.keep(empty(spark)).count() == 0


# ---- 4


def passages_by_hand(texts, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for i, x in enumerate(items):
            v = words(x)
            n = min(window, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1 if n else 0):
                if tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    ids.add(str(i))
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("rows", [100_000, 7])
def test_decontamination(spark, rows):
    r = random.Random(8)
    items = [prose(40, r), prose(13, r), prose(12, r), "Ünly thrée wörds", "solo", None, "", "la la la la la la la la la la la la la la la la"]
    own = [x.split() for x in items[:3]]
    texts = [
        f"{prose(30, r)} {' '.join(own[0][3:20])} {prose(9, r)}", f"{prose(30, r)} {' '.join(own[0][3:15])} {prose(9, r)}", items[1].upper().replace(" ", ", "), f"a {items[2]}", " ".join(own[2][:-1]),
        "x ünly, thrée. WÖRDS y", "Solo", "solo " * 3, None, "", "la " * 40, f"{items[0]} {items[0]}", prose(20_000, r) + " " + items[1], items[0][5:], prose(12, r),
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("k", F.lit("clash"))
    found = decontamination.find_passages(docs(spark, texts), bench, broadcast_rows=rows)
    found = found.select("doc_id", "n_words", "n_hit", F.size("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("sha"), decontamination.is_contaminated().alias("c"))
    got = {x[0]: tuple(x)[1:] for x in found.collect()}
    assert [got[k] for k in range(len(texts))] == passages_by_hand(texts, items)
    again = [(4, texts[0]), (4, texts[0]), (4, texts[1]), (None, texts[0]), (None, None)]
    found = decontamination.find_passages(spark.createDataFrame(again, "doc_id long, text string"), bench, broadcast_rows=rows)
    by_hand = passages_by_hand([t for _, t in again], items)
    assert sorted((x.doc_id or -1, x.n_words, x.n_hit) for x in found.collect()) == sorted((i or -1, n, h) for (i, _), (n, h, *_) in zip(again, by_hand, strict=True))


def test_decontaminated_texts(spark):
    r = random.Random(9)
    item = prose(20, r)
    long = prose(900, r)
    texts = [item, f"{long}, {item}! The end.", "clean", None, ""]
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    own = docs(spark, texts).select("doc_id", "text", "lang")
    got = {x.doc_id: x.text for x in decontamination.decontaminate(own, bench).collect()}
    assert got == {1: f"{long}! The end.", 2: "clean", 3: None, 4: ""}
    assert decontamination.decontaminate(own, bench.limit(0)).count() == 5
    assert decontamination.find_passages(empty(spark), bench).count() == 0


# ---- 5


def test_toxicity(spark):
    r = random.Random(10)
    texts = [prose(40, r) + (" you vile rotten foulbag" + word(r) + "." if k % 4 == 0 else ".") + prose(20, r) for k in range(240)] + [None, ""]
    labels = spark.createDataFrame([(k, None if k == 3 else int(k % 4 == 0)) for k in range(240)] + [(9999, 1), (None, 1)], "doc_id long, toxic int")
    rows = {x.doc_id: x for x in toxicity.score_toxicity(docs(spark, texts), labels).collect()}
    assert len(rows) == 242 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in rows.values())
    assert all(x.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, x in rows.items())
    held = [k for k in range(240) if rows[k].held_out]
    assert sum(rows[k].predicted == (k % 4 == 0) for k in held) >= 0.95 * len(held)
    assert not rows[240].predicted and not rows[241].predicted
    nothing = toxicity.score_toxicity(docs(spark, texts[:3]), labels.limit(0)).collect()
    assert [x.score for x in nothing] == [0.0] * 3
    assert toxicity.score_toxicity(empty(spark), labels).count() == 0


def test_toxicity_of_copies_and_long_texts(spark):
    """Repeated rows get equal scores, a third of all rows being one; what counts may stand at the end of a long text."""
    r = random.Random(11)
    texts = [prose(40, r) + (" you vile rotten foulbag." if k % 4 == 0 else ".") for k in range(160)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000, texts[0])] * 80 + [(1001, prose(30_000, r) + " you vile rotten foulbag.")]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(160)] + [(1000, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(got) == len(rows) and len({x.score for x in got if x.doc_id in (0, 1000)}) == 1
    assert {x.predicted for x in got if x.doc_id in (0, 1000, 1001)} == {1}


def test_grammar_reads_clauses():
    g = toxicity.Grammar({"idiot": 4.0, "murder": 2.0})
    score = lambda t: max(g.matches(t), default=0)
    assert score("you idiot.") > score("an idiot.") > score("she said an idiot.") > 0
    assert score("idiot you.") == score("you idiot.") and score("idiot a b c you.") == score("an idiot.")
    assert score("not an idiot.") < score("an idiot.")
    assert score("I will kill you.") > 0 == score("kill time.")
    assert score("murder you.") > score("murder.") > 0  # a threat that the lexicon knows, too
    assert score("not an idiot. you idiot.") == score("you idiot.")
    assert score("") == score(None) == 0


def all_paths(machines, symbols):
    """Every path through each transducer in turn, by enumeration: (output, weight)."""
    found = [(symbols, 0)]
    for m in machines:
        step = []
        for own, weight in found:
            open_ = [(0, (), weight)]
            for s in own:
                open_ = [(to, (*out, o), w + v) for state, out, w in open_ for o, v, to in m.arcs.get(state, {}).get(s, ())]
            step += [(out, w) for state, out, w in open_ if state in m.final]
        found = step
    return found


def test_composition_is_the_enumeration_of_paths():
    r = random.Random(12)
    machines = toxicity.parts(8)
    whole = toxicity.reduce(toxicity.compose, machines)
    alphabet = [toxicity.OTHER, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, ("i", 3), ("i", 8), ("k", 0), ("k", 5)]
    for _ in range(400):
        symbols = tuple(r.choice(alphabet) for _ in range(r.randint(0, 9)))
        assert toxicity.best_path(whole, list(symbols)) == max(w for _, w in all_paths(machines, symbols))


# ---- 6


def brute_nearest(rows, every=50):
    """rows (vec_id, vector): of one id the smallest vector counts."""
    one = {}
    for k, e in rows:
        one[k] = min(one.get(k, e), e)
    ids = sorted(one)
    y = np.array([one[k] for k in ids])
    y = y / np.abs(y).max(1)[:, None]
    y /= np.sqrt((y * y).sum(1))[:, None]
    out = {}
    for at, q in enumerate(ids):
        if q % every == 0:
            s = y @ y[at]
            out[q] = [(k, s[i]) for i, k in sorted(((i, k) for i, k in enumerate(ids) if k != q), key=lambda x: (-round(s[x[0]], 12), x[1]))[:5]]
    return out


@pytest.mark.parametrize("wanted", [None, 1e9])
def test_nearest(spark, wanted):
    r = np.random.default_rng(12)
    x = r.integers(-8, 9, (400, 8)).astype(np.float64)
    x[:, 0] = 9
    x[100:200] = x[100]  # a vector of a quarter of the rows
    x[210:250] = x[210] * 2.0 ** np.arange(40)[:, None]  # ties of different vectors, of more than 4 * 5
    x[300], x[301], x[350] = x[300] * 2.0**-700, x[301] * 2.0**700, x[300] * 2.0**600
    fine = [(k, [float(v) for v in e]) for k, e in enumerate(x)] + [(0, x[0].tolist()), (20, x[30].tolist()), (50, x[60].tolist()), (50, x[50].tolist())]
    rows = [*fine, (500, None), (550, [0.0] * 8), (600, [1.0, None] * 4), (650, [float("nan")] * 8), (700, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("level", F.lit("clash"))
    got = defaultdict(list)
    for q in nearest.nearest(df, bucket=60, wanted=wanted, goal=1.0).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.rank, q.vec_id, q.score))
    best = brute_nearest(fine)
    assert sorted(got) == sorted(best)
    for q, found in got.items():
        assert [k for _, k, _ in found] == [k for k, _ in best[q]] and [n for n, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(math.isclose(v, s, abs_tol=1e-12) for (_, _, v), (_, s) in zip(found, best[q], strict=True))
    if wanted is None:
        assert nearest.nearest(df.limit(0)).count() == 0
        assert nearest.nearest(df.where("vec_id = 350")).count() == 0


def test_forest_wants_few_candidates_where_neighbours_are_near(spark):
    r = np.random.default_rng(13)
    centres = r.standard_normal((300, 32))
    x = centres[r.integers(0, 300, 3000)] + 0.15 * r.standard_normal((3000, 32))
    df = spark.createDataFrame([(k, e.tolist()) for k, e in enumerate(x)], "vec_id long, embedding array<double>")
    p = nearest.planes(32)
    entries = df.select(F.col("vec_id").alias("entry"), "embedding")
    _, trees, wanted = nearest.fit(entries, 3000, 32, p, 1, 5, 0.95)
    assert wanted < 3000  # not a scan
    got = defaultdict(set)
    for q in nearest.nearest(df, bucket=300, trees=trees, wanted=wanted).collect():
        got[q.query_id].add(q.vec_id)
    y = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 3000, 50):
        s = y @ y[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * 5 * 60
    loose = spark.createDataFrame([(k, e.tolist()) for k, e in enumerate(r.standard_normal((1500, 32)))], "entry long, embedding array<double>")
    assert nearest.fit(loose, 1500, 32, p, 1, 5, 0.99)[1:] == (1, math.inf)  # a scan, and it says so


# ---- 7


def der(*parts, tag=0x30):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else b"\x82" + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


def test_secrets(spark):
    import base64 as b

    key = der(der(b"\0", tag=2), *[der(bytes([k]) * 32, tag=2) for k in range(1, 9)])
    url = lambda x: b.urlsafe_b64encode(x).decode().rstrip("=")
    token = f"{url(b'{\"alg\":\"HS256\"}')}.{url(b'{\"sub\":1}')}.abc"
    texts = [
        "é password = 'abcdef' token=abc, API_KEY:\"xyz/12+3\" password=token=abcdefg", "AKIA" + "A" * 16 + " AKIA" + "B" * 15, "0123456789abcdef01234567 0123456789abcdef0123456", f"x {token} y", f"{token[:5]}.{token[5:]}",
        b.b64encode(key).decode(), b.b64encode(key[:-1]).decode(), key.hex(), f"-----BEGIN RSA PRIVATE KEY-----\n{b.encodebytes(key).decode()}-----END RSA PRIVATE KEY-----", None, "", "z" * 200_000 + " secret: " + "q" * 9,
    ]
    rows = {x.doc_id: x for x in secrets.scan_secrets(docs(spark, texts)).collect()}
    patterns = (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24))
    for k, t in enumerate(texts):
        base = [(m.start(), i, f"{n}:{m.start()}:{m.end()}") for i, (n, p, least) in enumerate(patterns) for m in re.finditer(p, t or "") if len(m[2] if n == "assign" else m[0]) >= least]
        joined = ",".join(x for *_, x in sorted(base))
        assert rows[k].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (rows[k].n_assign, rows[k].n_access, rows[k].n_hex) == tuple(sum(x.startswith(n) for *_, x in base) for n, *_ in patterns)
        assert set(filter(None, joined.split(","))) <= set(rows[k].spans.split(","))
    assert rows[3].spans == f"jwt:2:{2 + len(token)}" and "jwt" not in rows[4].spans
    assert rows[5].spans.startswith("der:0:") and not rows[6].spans and "der" in rows[7].spans and "pem:0:" in rows[8].spans
    assert secrets.scan_secrets(empty(spark)).count() == 0


# ---- 8


@pytest.mark.parametrize("part", [1 << 20, 40])
def test_chat_format(spark, part, monkeypatch):
    control = "<|im_end|><|im_start|>assistant ok"
    turns = [
        (1, 0, "system", "be \\ kind"), (1, 1, "user", None), (1, 2, "assistant", "\n two  spaces <|im_sep|> \\<| <"), (1, 2, "assistant", "\n two  spaces <|im_sep|> \\<| <"), (2, 0, "user", control), (2, 1, "assistant", control),
        (3, 0, "assistant", ""), (3, 1, None, "x"), (None, 0, "assistant", "😀 é<|endoftext|>"), (4, 5, "assistant", "b" * 5000), (4, 3, "assistant", "a\\"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    monkeypatch.setattr(chat_format, "PART", part)
    by = defaultdict(list)
    for c, t, role, text in sorted(turns, key=lambda x: (x[0] or 0, x[1], x[2] or "", x[3] or "")):
        by[c].append((role or "", text or ""))
    rows = {x.conv_id: x for x in chat_format.format_conversations(df).collect()}
    assert set(rows) == set(by)
    for c, own in by.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert rows[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (rows[c].n_turns, rows[c].loss_chars, rows[c].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    texts = chat_format.format_conversations(df, texts=True).collect()
    assert {x.conv_id for x in texts} == set(by) and all(len(x.ids) == len(x.mask) for x in texts)
    assert [t for x in texts if x.conv_id == 2 for t in chat_format.read_turns(x.text)] == by[2]
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_escapes_undo():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=200, deadline=None)
    @given(st.text(alphabet="\\<|>a\n"))
    def check(x):
        made = chat_format.escape(x)
        assert chat_format.unescape(made) == x and "<|" not in made
        assert chat_format.read_turns(chat_format.render([("user", x)])[0]) == [("user", x)]

    check()


# ---- 9


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = [prose(R.randint(1, 900)) + "." for _ in range(30)] + [None, "", "Don't, ÉÉ ÀÀ. x,, 12 <|endoftext|>,", prose(9000), " \n ", "Dup.", "Dup."]
    rows = packing.pack_documents(docs(spark, texts), with_ids=True).collect()
    t = Tokenizer.from_file(packing.default_tokenizer())
    by, runs = defaultdict(list), defaultdict(list)
    for x in rows:
        by[x.doc_id].append(x)
        runs[x.sequence_id].append(x)
    for k, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(by[k], key=lambda x: x.start)
        assert [i for x in own for i in x.ids] == ids and [x.start for x in own] == [sum(y.length for y in own[:n]) for n in range(len(own))]
        assert all(x.doc_tokens == len(ids) and x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes()) for x in own)
    waste = 0
    for own in runs.values():
        own.sort(key=lambda x: x.offset)
        total = sum(x.length for x in own)
        assert [x.offset for x in own] == [sum(y.length for y in own[:n]) for n in range(len(own))] and total <= 2048
        waste += 0 if total & (total - 1) == 0 else 2048 - total
    assert waste <= 2048 * 5  # a short sequence for each partition, about
    assert packing.pack_documents(empty(spark)).count() == 0


def test_words_are_encoded_as_the_tokenizer_does():
    import sys

    from hypothesis import given, settings
    from hypothesis import strategies as st

    words = packing.Words(packing.default_tokenizer())
    whole = lambda x: words.tokenizer.encode(x, add_special_tokens=False).ids
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha()]
    letters = [c for k, c in enumerate(letters) if k % 20 == 0 or unicodedata.normalize("NFC", c).lower() != c]  # all that the tokenizer changes
    for k in range(0, len(letters), 12_000):
        text = " ".join(f"{c}{t} x{c}{t}" for c in letters[k : k + 4000] for t in ",.")
        assert words.encode([text])[0].tolist() == whole(text)
    text = "D\u0130YARBAKIRI\u0307, D\u0130YARBAKIR\u0130, \u0915\u093c. \u0958. \ufb2a, x\u0338. >\u0338y"
    assert words.encode([text])[0].tolist() == whole(text)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from("aB, .\n\t'\u0130\u0307\u0301\u0338é1<|>"), st.characters(codec="utf-8"))))
    def check(x):
        assert words.encode([x])[0].tolist() == whole(x)

    check()


class Told:
    """A tokenizer that tells what it is given."""

    def __init__(self, own):
        self.own, self.texts = own, []

    def encode_batch_fast(self, texts, **more):
        self.texts += texts
        return self.own.encode_batch_fast(texts, **more)

    def encode(self, text, **more):
        self.texts.append(text)
        return self.own.encode(text, **more)


def test_words_are_learned_by_pieces():
    """What a word adds to known pieces is all that is encoded for it; the whole tokenizer sees none of it."""
    words = packing.Words(packing.default_tokenizer())
    whole = Told(words.tokenizer)
    words.tokenizer = whole
    if getattr(words, "merger", None):
        words.merger = Told(words.merger)
    words.encode(["straße 's"])
    given, text = len(whole.texts), "STRAßE### Straße### straße... straße's STRAßE'S"
    assert words.encode([text])[0].tolist() == whole.own.encode(text, add_special_tokens=False).ids
    assert whole.texts[given:] == [] and sorted(words.merger.texts[-1].split(" ")) == ["###", "..."]


def test_pieces_are_those_of_the_tokenizer():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    words = packing.Words(packing.default_tokenizer())
    whole = lambda x: words.tokenizer.encode(x, add_special_tokens=False).ids
    letters = [c for c in map(chr, range(0x3000)) if packing.LATIN.fullmatch(c)]
    assert words.merger and len(letters) > 150
    text = " ".join(f"{a}{b}" for a in letters for b in letters)
    assert words.encode([text])[0].tolist() == whole(text)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("'sStTlLmMdDrevE1."), st.sampled_from(letters))), max_size=5))
    def check(x):
        assert words.encode(x + [" ".join(x)])[-1].tolist() == whole(" ".join(x))

    check()


@pytest.mark.parametrize("part", [1, 40, 1 << 23])
def test_slices_hold_every_row_once(monkeypatch, part):
    monkeypatch.setattr(packing, "SLICE", part)
    texts = ["", None, "a b", "", "x" * 100, None, "é y", ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(8)), "text": texts})
    made = [x.to_pylist() for x in packing.slices(batch)]
    assert [y for x in made for y in x] == batch.to_pylist() and all(made)
    assert list(packing.slices(batch.slice(0, 0))) == [] and len(list(packing.slices(batch.slice(4, 1)))) == 1


@pytest.mark.parametrize("length", [16, 24, 2048])
def test_cuts_are_the_cheapest(length):
    """With runs that aren't padded, as 1, 2, 4, ... below the length are powers of two."""
    r = np.random.default_rng(3)
    for _ in range(40):
        at = np.unique(np.append([0], r.integers(1, 4 * length, 30 if length < 100 else 300)))
        pen = r.integers(0, 6, len(at)).astype(float)
        if max(np.diff(at)) > length:
            continue
        padding = lambda n: 0 if n & (n - 1) == 0 else length - n
        cost = [0.0] + [math.inf] * (len(at) - 1)
        for j in range(1, len(at)):
            cost[j] = pen[j] + min(cost[i] + padding(int(at[j] - at[i])) for i in range(j) if at[j] - at[i] <= length)
        ends = [0, *packing.best_cuts(at, pen, length).tolist()]
        assert math.isclose(sum(padding(b - a) + pen[at.tolist().index(b)] for a, b in zip(ends, ends[1:], strict=False)), cost[-1])


# ---- 10


def test_sharding(spark):
    r = random.Random(20)
    texts = [prose(r.randint(1, 40), r) for _ in range(400)] + ["a copy that many have"] * 200 + [None, None, "", "é" * 3000]
    rows = sharding.shard_documents(docs(spark, texts), shards=8).collect()
    assert len(rows) == len(texts) and {x.law for x in rows} == {"bytes"}
    by = defaultdict(list)
    for x in rows:
        text = texts[x.doc_id] or ""
        assert (x.size, x.text_crc32, x.grown_shard) == (len(text.encode()) + 16, zlib.crc32(text.encode()), None)
        by[x.shard].append(x)
    assert sorted(by) == list(range(8)) and all(sorted(x.slot for x in own) == list(range(len(own))) for own in by.values())
    sizes = [sum(x.size for x in own) for own in by.values()]
    assert max(sizes) - min(sizes) <= 2 * 6016
    assert sharding.shard_documents(empty(spark)).count() == 0
    assert sharding.shard_documents(docs(spark, ["a"])).count() == 1


def test_sharding_cuts_only_groups_larger_than_a_shard(spark):
    r = random.Random(22)
    texts = [f"{k} {prose(r.randint(1, 12), r)}" for k in range(4000)]
    total = sum(len(x) + 16 for x in texts) / 0.883
    for share, text in ((0.017, "a" * 24), (0.1, "b" * 34)):
        texts += [text] * int(total * share / (len(text) + 16))
    rows = sharding.shard_documents(docs(spark, texts)).collect()
    by = defaultdict(list)
    for x in rows:
        by[x.shard].append(x)
    assert all(sorted(x.slot for x in own) == list(range(len(own))) for own in by.values()) and len(rows) == len(texts)
    shards = lambda t: {x.shard for x in rows if texts[x.doc_id] == t}
    assert len(shards("a" * 24)) == 1 and 4 <= len(shards("b" * 34)) <= 6
    sizes = [sum(x.size for x in own) for own in by.values()]
    assert len(by) == 40 and max(sizes) < 1.1 * sum(sizes) / 40


def test_sharding_ranks_many_small_copies_in_parts(spark):
    rows = spark.createDataFrame([(k % 7, None if k % 3 else f"some text {k} " * 50) for k in range(3000)], "doc_id long, text string")
    by = defaultdict(list)
    for x in sharding.shard_documents(rows, shards=4).collect():
        by[x.shard].append(x)
    assert sum(map(len, by.values())) == 3000 and all(sorted(x.slot for x in own) == list(range(len(own))) for own in by.values())
    assert len({s for s, own in by.items() if any(x.size == 16 for x in own)}) == 1


def test_capacity_is_the_smallest():
    from itertools import combinations

    for sizes, n in (([3, 1, 4, 1, 5, 9, 2, 6], 3), ([10, 1, 1, 1], 2), ([1], 4), ([], 2), ([5, 5, 5, 5], 4)):
        best = min((max(sum(sizes[a:b]) for a, b in zip((0, *c), (*c, len(sizes)), strict=True)) for k in range(min(n, max(1, len(sizes)))) for c in combinations(range(1, len(sizes)), k)), default=0)
        assert sharding.smallest_capacity(sizes, n) == best
        cut = sharding.cut_greedily(sizes, n)
        assert cut == sorted(cut) and all(sum(x for x, s in zip(sizes, cut, strict=True) if s == k) <= best for k in range(n))
