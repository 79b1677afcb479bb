"""Op 2: near-duplicates by fast similarity sketching, banding and exact verification.

A document's set of word shingles gets SKETCH coordinates: in round after round each shingle is hashed
to a bin, and a bin keeps the smallest value of the first round that reaches it; the last SKETCH rounds
each fill one given bin, so every coordinate fills, and two sets agree in a coordinate with a
probability of their similarity. BANDS bands of coordinates are buckets of candidates: two sets at the
threshold of 0.8 share none with a probability of (1 - 0.8 ^ 4) ^ 32, or 5 in 100 million.

Equal sets are one class from then on. Only components are wanted, so no bucket is expanded into pairs:
1. In each bucket, classes whose sketches don't rule the threshold out (DEVIATIONS standard deviations
   below it) are joined to groups: a bucket gives a tree, not its pairs, and trees are contracted. The
   first bands go first; of the others only buckets that still hold several groups.
2. A link can only be inside a group. The texts of a group come together, full sets are made again and
   their pairs counted exactly inside the task, which hands on a tree of the links. Components are what
   these trees connect.
Buckets and groups of more than BLOCK classes are dealt to blocks. First each block is looked at alone.
Then, in groups whose members would have to visit more than VISITS blocks each, one class of each
component that is left stands for it in blocks of such classes, for TURNS turns at most. What is still apart is settled exactly: the members of the largest component stay in
their block, and the others visit all blocks, a batch at a time. So no cap ends the search, a task
holds two blocks at most, and a family of copies that do link costs its own size, not its square.

Defined results: null and empty texts, and texts without words, have no shingles and are linked with
nothing; fewer words than a shingle form one shingle. Rows that share a doc_id are one node: their sets
are compared each for itself, and linked with one another. A null doc_id is linked with nothing: its
component_id is null and it is kept. Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, cut_in_loop, keep_columns, lean, table

SKETCH, BANDS, FIRST, BLOCK, WIDTH, SLAB, DEVIATIONS, BITMAP, TURNS, VISITS = 128, 32, 6, 512, 5, 100_000, 4.5, 1 << 23, 2, 16
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SALTS = np.random.default_rng(11).integers(1, 1 << 63, 2 * SKETCH, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M2
        x = (x ^ (x >> np.uint64(27))) * M1
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, sorted."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(h))):
            out = _mix(out * M1 + h[k : k + n])
    return np.unique(out)


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH coordinates of a set that isn't empty."""
    out, full, at = np.zeros(SKETCH, np.uint64), np.zeros(SKETCH, bool), 0
    while not full.all():
        rounds = np.arange(at, min(2 * SKETCH, at + max(1, 5 * SKETCH // len(s))))
        x = _mix(s[None, :] ^ SALTS[rounds][:, None])
        bins = np.where((rounds < SKETCH)[:, None], x >> np.uint64(57), np.maximum(rounds - SKETCH, 0).astype(np.uint64)[:, None])
        key = np.sort((bins << np.uint64(57) | rounds.astype(np.uint64)[:, None] << np.uint64(49) | x & np.uint64((1 << 49) - 1)).ravel())
        to = (key >> np.uint64(57)).astype(np.int64)
        first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        first = first[~full[to[first]]]
        out[to[first]], full[to[first]] = key[first], True
        at = rounds[-1] + 1
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    h = np.zeros(BANDS, np.uint64)
    with np.errstate(over="ignore"):
        for c in coordinates.reshape(BANDS, -1).T:
            h = _mix(h * M1 + c)
    return h.view(np.int64)


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (the set's fingerprint), bands, sketch (a byte for each coordinate)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, bs, sk = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, width)
                n.append(len(s))
                d = _fingerprint(s)
                f1.append(d[0])
                f2.append(d[1])
                c = sketch(s) if len(s) else None
                bs.append(None if c is None else bands(c))
                sk.append(None if c is None else (_mix(c) & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bs, pa.list_(pa.int64())), pa.array(sk, pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "bands", "sketch"])

    docs = keep_columns(docs, "doc_id", "text")
    return docs.mapInArrow(lean(make), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, f1 long, f2 long, bands array<long>, sketch binary")


# ---- groups of candidates


def _pairs(end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of rows in the same group, about SLAB at a time; a row's group ends at end[row]."""
    counts = end - np.arange(len(end)) - 1
    total = np.concatenate(([0], np.cumsum(counts)))
    a = 0
    while a < len(end):
        b = max(a + 1, int(np.searchsorted(total, total[a] + SLAB, "right")) - 1)
        c = counts[a:b]
        i = np.repeat(np.arange(a, b), c)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        a = b


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that it is connected with by the edges i - j."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (step := root[root] != root).any():
            root[step] = root[root[step]]
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root


def _ends(group: np.ndarray) -> np.ndarray:
    """Where each row's group ends, for rows sorted by group."""
    change = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)) if len(group) else np.zeros(0, int)
    return change[np.searchsorted(change, np.arange(len(group)), "right")] if len(group) else change


def _tree(ids: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Pairs (id, id) that connect what the index pairs left - right connect."""
    if not left:
        return np.zeros((0, 2), np.int64)
    root = roots(len(ids), np.concatenate(left), np.concatenate(right))
    at = np.flatnonzero(root != np.arange(len(ids)))
    pair = np.stack([ids[at], ids[root[at]]], 1)
    return np.unique(pair[pair[:, 0] != pair[:, 1]], axis=0)


def candidates(group: np.ndarray, visits: np.ndarray, ids: np.ndarray, comp: np.ndarray, n: np.ndarray, sk: np.ndarray, threshold: float) -> np.ndarray:
    """Trees (id, id) over the rows of each group whose sketches don't rule a link out.

    Rows of one comp are connected already, and visitors aren't compared with one another."""
    least = (threshold - DEVIATIONS * (threshold * (1 - threshold) / SKETCH) ** 0.5) * SKETCH
    left, right = [], []
    for i, j in _pairs(_ends(group)):
        ok = (comp[i] != comp[j]) & ~(visits[i] & visits[j]) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-6)
        i, j = i[ok], j[ok]
        ok = (sk[i] == sk[j]).sum(1) >= least
        left.append(i[ok])
        right.append(j[ok])
    return _tree(ids, left, right)


def _parts(now: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Where equal rows of `now` begin and end, and no part longer than size."""
    cuts = [0, *(np.flatnonzero((now[1:] != now[:-1]).any(1)) + 1).tolist(), len(now)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        for k in range(a, b, size):
            yield k, min(b, k + size)


def _connect(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """Candidate trees a, b from members (bucket, block, visits, id, comp, n, sketch).

    A task holds the residents of one block and one batch of its visitors, which come after them."""
    names = ["bucket", "block", "visits", "id", "comp", "n"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sk = np.zeros((0, 6), np.int64), np.zeros((0, SKETCH), np.uint8)  # what waits: whole groups, and residents of the last

        def out(done: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rows, sk
            change = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1)) if len(rows) else np.zeros(0, bool)
            last = len(rows) if done or not len(rows) else int(np.flatnonzero(change)[-1])
            open_visits = np.flatnonzero(rows[last:, 2]) + last  # visitors of the open group are compared now, and go
            upto = len(rows) if len(open_visits) >= block or done else last
            if upto:
                group = np.cumsum(change[:upto])
                p = candidates(group, rows[:upto, 2] > 0, rows[:upto, 3], rows[:upto, 4], rows[:upto, 5], sk[:upto], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1]))], ["a", "b"])
            keep = np.arange(len(rows)) >= last
            if upto > last:
                keep &= rows[:, 2] == 0
            rows, sk = rows[keep], sk[keep]

        for batch in batches:
            new = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], 1)
            some = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            for a, b in _parts(new[:, :3], 4 * block):
                rows, sk = np.concatenate([rows, new[a:b]]), np.concatenate([sk, some[a:b]])
                if len(rows) >= 4 * block:
                    yield from out(False)
        yield from out(True)

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.select(*names, "sketch").repartition(n, "bucket", "block").sortWithinPartitions("bucket", "block", "visits").mapInArrow(lean(find), "a long, b long").distinct()


def _visiting(members: DataFrame, key: str, size: Column, block: int, comps: bool) -> DataFrame:
    """members (key, id, comp, ...) with block and visits: each stays in a block of about `block` members.

    comps: all but the members of the key's largest comp visit the other blocks, too."""
    blocks = F.greatest(F.ceil(size / block).cast("int"), F.lit(1))
    members = members.withColumn("__own", F.pmod(F.xxhash64("id", F.lit("block")), blocks).cast("int"))
    if not comps:
        return members.withColumns({"block": F.col("__own"), "visits": F.lit(0)}).drop("__own")
    most = members.where(size > block).groupBy(key, "comp").count().groupBy(key).agg(F.max_by("comp", F.struct("count", "comp")).alias("__most"))
    to = F.when((size <= block) | (F.col("comp") == F.col("__most")), F.array("__own")).otherwise(F.sequence(F.lit(0), blocks - 1))
    out = members.join(most, key, "left").withColumn("block", F.explode(to))
    return out.withColumn("visits", (F.col("block") != F.col("__own")).cast("int")).drop("__own", "__most")


# ---- exact verification


def linked(sets: list[np.ndarray], visits: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with den * intersection >= num * union; visitors aren't compared with one another."""
    m, size = len(sets), np.array([len(x) for x in sets], np.int64)
    if m <= 6:
        common = np.zeros((m, m))
        for i in range(m):
            for j in range(i):
                if not (visits[i] and visits[j]) and min(size[i], size[j]) * den >= num * max(size[i], size[j]):
                    common[i, j] = common[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), size)
        order = np.argsort(column, kind="stable")
        order = order[times[column[order]] > 1]  # what one set alone has is in no intersection
        row, column = row[order], column[order]
        home = np.flatnonzero(~visits)
        common, step = np.zeros((m, m), np.float32), 4096
        while len(row):
            own = np.unique(column[: 64 * step])[:step]
            stop = int(np.searchsorted(column, own[-1], "right"))
            dense = np.zeros((m, len(own)), np.float32)
            dense[row[:stop], np.searchsorted(own, column[:stop])] = 1
            common[home] += dense[home] @ dense.T
            row, column = row[stop:], column[stop:]
        common = np.maximum(common, common.T)
    i, j = np.nonzero(np.triu(common, 1))
    c = common[i, j].astype(np.int64)
    ok = den * c >= num * (size[i] + size[j] - c)
    return i[ok], j[ok]


def _some_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id may be in wanted (least): a bitmap of BITMAP bits, at any input size, tells most others."""
    bit = F.pmod(F.xxhash64("least"), F.lit(BITMAP))
    words = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS INT)))").alias("m"))
    bitmap = np.zeros(BITMAP // 64, np.int64)
    for w, m in words.collect():
        bitmap[w] = m
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("bit").to_numpy()
            hit = held.value.view(np.uint64)[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
            yield batch.select(["doc_id", "text"]).filter(pa.array(hit == 1))

    rows = keep_columns(docs, "doc_id", "text").where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(BITMAP)).alias("bit"))
    return rows.mapInArrow(lean(some), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def verified(docs: DataFrame, members: DataFrame, width: int, num: int, den: int, block: int) -> DataFrame:
    """Trees (a, b) of exact links among members (id, least, f1, f2, grp, block, visits) of a group's block.

    least is a document of the class: its text with the set f1, f2 is taken. A task holds the residents
    of one block and one batch of visitors, which come after them."""
    texts = _some_of(docs, members).join(members, F.col("doc_id") == F.col("least")).select("id", "text", "f1", "f2", "grp", "block", "visits")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, visits, sets, home = None, [], [], [], 0
        out: list[np.ndarray] = []

        def close() -> None:
            nonlocal ids, visits, sets
            if len(ids) > max(1, home if any(visits) else 1):
                i, j = linked(sets, np.array(visits, bool), num, den)
                out.append(_tree(np.array(ids, np.int64), [i], [j]))
            ids, visits, sets = ids[:home], visits[:home], sets[:home]

        def made() -> pa.RecordBatch:
            p = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1]))], ["a", "b"])

        for batch in batches:
            for grp, at, visit, i, text, f1, f2 in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "visits", "id", "text", "f1", "f2")), strict=True):
                if (grp, at) != now:
                    close()
                    now, ids, visits, sets, home = (grp, at), [], [], [], 0
                if len(ids) - home >= block and visit:
                    close()
                if ids and ids[-1] == i:
                    continue
                s = shingles(text, width)
                if _fingerprint(s) == (f1, f2):
                    ids.append(i)
                    visits.append(visit)
                    sets.append(s)
                    home += not visit
            if out:
                yield made()
        close()
        yield made()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.repartition(n, "grp", "block").sortWithinPartitions("grp", "block", "visits", "id").mapInArrow(lean(check), "a long, b long").distinct()


# ---- components


def contract(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, comp) after links (a, b) between ids: comp is the smallest comp that links reach."""
    one, two = labels.select(F.col("id").alias("a"), F.col("comp").alias("ca")), labels.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    edges = cut_in_loop(links.join(one, "a").join(two, "b").where("ca != cb").select("ca", "cb").distinct())
    moved = None  # comps that have another name by now
    while not edges.isEmpty():
        ways = edges.unionByName(edges.select(F.col("cb").alias("ca"), F.col("ca").alias("cb")))
        to = cut_in_loop(ways.groupBy(F.col("ca").alias("x")).agg(F.least(F.min("cb"), F.col("x")).alias("y")))
        for _ in range(2):  # to the place where the next ones point
            step = to.select(F.col("x").alias("y"), F.col("y").alias("z"))
            to = to.join(step, "y", "left").select("x", F.coalesce("z", "y").alias("y"))
        to = cut_in_loop(to)
        if moved is not None:
            known = moved.join(to.select(F.col("x").alias("y"), F.col("y").alias("z")), "y", "left").select("x", F.coalesce("z", "y").alias("y"))
            to_new = to.join(moved.select("x"), "x", "left_anti")
        moved = to if moved is None else cut_in_loop(known.unionByName(to_new))
        ends = [to.select(F.col("x").alias(c), F.col("y").alias(f"{c}_to")) for c in ("ca", "cb")]
        edges = cut_in_loop(edges.join(ends[0], "ca").join(ends[1], "cb").select(F.col("ca_to").alias("ca"), F.col("cb_to").alias("cb")).where("ca != cb").distinct())
    if moved is None:
        return labels
    return cut_in_loop(labels.join(moved.select(F.col("x").alias("comp"), "y"), "comp", "left").select("id", F.coalesce("y", "comp").alias("comp")))


def _one_node(some: DataFrame, first: DataFrame) -> DataFrame | None:
    """Links (a, b) between the classes of rows that share a doc_id; None where none does."""
    key = F.struct("f1", "f2")
    twice = cut(some.groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low != high").select("doc_id"))
    if twice.isEmpty():
        return None
    own = cut(some.join(twice, "doc_id", "left_semi").select("doc_id", "f1", "f2").distinct().join(first.select("f1", "f2", "id"), ["f1", "f2"]).select("doc_id", "id"))
    return cut(own.join(own.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b")).where("a != b"))


def _links(docs: DataFrame, groups: DataFrame, alone: DataFrame, width: int, num: int, den: int, block: int) -> DataFrame:
    """labels (id, comp) by the exact links inside groups (id, least, f1, f2, grp, m)."""
    check = lambda members: cut(verified(docs, members, width, num, den, block))
    labels = contract(alone, check(_visiting(groups, "grp", F.col("m"), block, False)))
    large = groups.where(F.col("m") > block)
    if large.isEmpty():
        return labels
    for turn in range(TURNS + 1):
        now = large.drop("m").join(labels, "id")
        apart = now.groupBy("grp").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m")).where("low != high").select("grp", "m")
        now = cut(now.join(apart, "grp"))
        if now.isEmpty():
            break
        exact = turn == TURNS or _visits(now, block) <= VISITS
        if not exact:
            columns = F.struct("id", "least", "f1", "f2")
            now = now.groupBy("grp", "comp").agg(F.min_by(columns, F.xxhash64("id", F.lit(turn))).alias("c")).select("grp", "comp", "c.*")
            now = now.join(now.groupBy("grp").agg(F.count("*").alias("m")), "grp")
        labels = contract(labels, check(_visiting(now, "grp", F.col("m"), block, exact)))
        if exact:
            break
    return labels


def _visits(members: DataFrame, block: int) -> float:
    """How many visits a member (grp, comp, m) of a large group would make, on average."""
    most = members.groupBy("grp", "comp").agg(F.count("*").alias("n"), F.max("m").alias("m")).groupBy("grp").agg(F.max("m").alias("m"), F.max("n").alias("n"))
    return most.agg(F.sum((F.col("m") - F.col("n")) * F.ceil(F.col("m") / block)) / F.sum("m")).first()[0] or 0


def link_components(docs: DataFrame, width: int = WIDTH, num: int = 80, den: int = 100, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs."""
    made = cut(sketches(docs, width))
    some = made.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # A class is a set; its id is a number of its own, fixed by writing the table.
    first = cut(some.groupBy("f1", "f2").agg(F.min("doc_id").alias("least")).withColumn("id", F.monotonically_increasing_id()))
    classes = cut(
        some.join(first, (F.col("doc_id") == F.col("least")) & (some.f1 == first.f1) & (some.f2 == first.f2))
        .select("id", "least", some.f1, some.f2, F.col("n_shingles").alias("n"), "bands", "sketch").dropDuplicates(["id"])
    )
    rows = classes.select("id", F.posexplode("bands").alias("band", "h")).select("id", "band", F.xxhash64("band", "h").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(rows.join(sizes, "bucket"))
    alone = classes.select("id", F.col("id").alias("comp"))
    labels, threshold = alone, num / den
    for turn in range(2):
        now = (members if turn else members.where(F.col("band") < FIRST)).join(labels, "id")
        if turn:
            mixed = now.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("bucket")
            now = now.join(mixed, "bucket")
        now = _visiting(now.select("bucket", "size", "id", "comp"), "bucket", F.col("size"), block, bool(turn))
        labels = contract(labels, cut(_connect(now.join(classes.select("id", "n", "sketch"), "id"), threshold, block)))
    sizes = cut(labels.groupBy(F.col("comp").alias("grp")).agg(F.count("*").alias("m")).where("m > 1"))
    groups = cut(labels.withColumnRenamed("comp", "grp").join(sizes, "grp").join(classes.select("id", "least", "f1", "f2"), "id"))
    labels = _links(docs, groups, alone, width, num, den, block)
    same = _one_node(some, first)
    labels = labels if same is None else contract(labels, same)
    held = first.join(labels, "id").select("f1", "f2", "least", "comp")
    named = cut(held.join(held.groupBy("comp").agg(F.min("least").alias("name")), "comp").select("f1", "f2", "name"))
    out = made.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("f1")).alias("f1"), "f2").join(named, ["f1", "f2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("name", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("name", "doc_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs without all but one of each component.

    Of rows that share a doc_id the one stays whose text has the smallest hash; without a doc_id all stay."""
    gone = link_components(docs, width).where("NOT kept").select("doc_id").distinct()
    names = [f"`{c}`" for c in docs.columns]
    kept = docs.join(gone, "doc_id", "left_anti").select(*names)
    twice = cut(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():
        return kept
    own = kept.join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("__id"), F.struct(*names).alias("__r"))
    own = own.groupBy("__id").agg(F.min_by("__r", F.xxhash64("__r.text")).alias("__r")).select("__r.*")
    return kept.join(twice, "doc_id", "left_anti").select(*names).unionByName(own)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"), width=4)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM w WHERE len(w) > 0)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT x.a, x.b FROM (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS c FROM s JOIN s t ON s.g = t.g AND s.doc_id <> t.doc_id GROUP BY ALL) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * x.c >= 80 * (na.n + nb.n - x.c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), comp AS (
  SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a
)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""
