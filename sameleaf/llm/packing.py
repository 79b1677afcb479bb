"""Op 9: documents packed in order into sequences of at most 2048 tokens, by dynamic programming.

Documents stay in the order of their rows. Sequences are runs of the token stream; a run may end at a
document's end (no penalty), at a sentence's end, or at every GRID tokens (the largest penalty). The
cost of a run is its padding plus the penalty of its end; a run of a power of two (all of 1 to 1024)
isn't padded. With
f(j) = penalty(j) + LENGTH - p(j) + min over i in the window of (f(i) + p(i)), the minimum comes from
a monotone queue, so a cut costs constant time.

Each partition packs its own rows as a stream: at most about CHUNK tokens and one document are packed at
once, a slice of SLICE bytes (or one document) is held beside them, and the last, unfinished sequence of a
chunk goes on in the next. Nothing is shuffled, so no key, source or group of copies gathers anywhere; a
partition leaves one sequence that may be short.

A word's ids don't depend on the words around it (the tokenizer splits at white space first), so each
worker keeps the ids of words that it has met, CACHE at most. A slice's words are counted off in Arrow, so
that each different one is looked up once. Words of LATIN go to pieces as the tokenizer takes them, and
its pieces that are new are merged without its normalizer and its splits.

Defined results: null and empty texts are the final id alone. Repeated rows are packed each. A text
is never cut short. Empty input gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import KEPT, give_back, keep_columns, lean, single_threaded, table

LENGTH, GRID, SENTENCE, HARD, END, CHUNK, SLICE, CACHE = 2048, 32, 3, 12, 1, 1 << 21, 1 << 23, 1_200_000
POWERS = tuple(1 << k for k in range(11))
BETWEEN = "<|endoftext|>"
STOPS = (".", "!", "?", "。", "！", "？")
#: Words of these are the same under NFC, and Python lower-cases them as the tokenizer does.
LATIN = re.compile("[!-~À-ÖØ-öø-ÿ¡¿«»–—“”‘’…]*")
#: The tokenizer's own pieces, and what they are in a lower-cased word of LATIN.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _plain(x: str, apart: Callable[[str], bool]) -> tuple[str, str]:
    """A word without its last comma or full stop, and that, where they are tokens apart. ASCII capitals make no difference.

    They are apart after an ASCII letter. After another letter it depends on how the tokenizer takes it
    to pieces (some become a letter and a mark, and a mark goes with the stop): apart tells.
    """
    base, tail = (x[:-1], x[-1]) if x[-1:] in (",", ".") and x[:-1].isalpha() and (x[-2].isascii() or apart(x[-2])) else (x, "")
    return (base.lower() if base.isascii() and base.isalpha() and base.lower() != x else base), tail


def _merger(tokenizer):
    """The same merges for pieces between blanks, as they are; None for a tokenizer of another kind."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    own, vocabulary = json.loads(tokenizer.to_str()), tokenizer.get_vocab()
    first, then = (own["normalizer"] or {}).get("normalizers", []), (own["pre_tokenizer"] or {}).get("pretokenizers", [])
    if (
        [x["type"] for x in first + then] != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]
        or (first[1]["pattern"], first[1]["content"]) != ({"Regex": r"\s+"}, " ")
        or (then[0]["pattern"], then[0]["behavior"], then[0]["invert"]) != ({"Regex": SPLIT}, "Removed", True)
        or (then[1]["add_prefix_space"], then[1]["use_regex"]) != (False, False)
        or (own["model"]["type"], own["model"]["end_of_word_suffix"]) != ("BPE", "</w>")
        or not all(x + "</w>" in vocabulary for x in ByteLevel.alphabet())
        or not all("<|" in x["content"] for x in own["added_tokens"])
    ):
        return None
    blanks = {"type": "CharDelimiterSplit", "delimiter": " "}
    return Tokenizer.from_str(json.dumps({**own, "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [blanks, then[1]]}}))


class Words:
    """Encodes whole texts, word by word, with the ids of words met before."""

    def __init__(self, path: str):
        single_threaded()
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.between = self.tokenizer.token_to_id(BETWEEN)
        self.stops = np.array(sorted({vocabulary[x] for s in STOPS for x in (s, s + "</w>", s * 3 + "</w>") if x in vocabulary}), np.uint32)

        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.merger = _merger(self.tokenizer)
        self.tails = {x: self._ids(x) for x in ("", ",", ".")}
        self.letters: dict[str, bool] = {}

    def apart(self, letter: str) -> bool:
        """Whether a stop after this letter is a token apart."""
        if letter not in self.letters:
            own = self._ids(letter)
            self.letters[letter] = all(self._ids(letter + t) == own + self.tails[t] for t in (",", "."))
        return self.letters[letter]

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _merge(self, words: list[str], between: str, tokenizer) -> None:
        """Many words are encoded at once. A piece's last token says that it ends; between others stands a special token."""
        for k in range(0, len(words), 5000):
            part = words[k : k + 5000]
            ids = np.array(tokenizer.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            if between == " ":
                ends = np.flatnonzero(self.closing[ids]) + 1
                starts = np.append(0, ends[:-1])
            else:
                gaps = np.flatnonzero(ids == self.between)
                starts, ends = np.append(0, gaps + 1), np.append(gaps, len(ids))
            own = ids.tobytes()
            for x, a, b in zip(part, (4 * starts).tolist(), (4 * ends).tolist(), strict=True):
                self.known[x] = own[a:b]

    def _learn(self, new: list[str]) -> None:
        """Words of LATIN are looked up as their pieces; of others the last stop is taken off, where _plain does so."""
        known, latin, parts, pieces, odd = self.known, [], {}, set(), set()
        for x in new:
            if "<|" in x:
                known[x] = self._ids(x)
            elif self.merger and LATIN.fullmatch(x):
                latin.append(x)
            else:
                base, tail = _plain(x, self.apart)
                parts[x] = (base, tail) if tail else (base,)
                odd.add(base)
                (pieces if self.merger else odd).update(parts[x][1:])
        same = []
        for x, low in zip(latin, "\n".join(latin).lower().split("\n"), strict=False):
            if low.isalpha():
                pieces.add(low)
                if low != x:
                    same.append((x, low))
            else:
                parts[x] = PIECES.findall(low)
                pieces.update(parts[x])
        self._merge([x for x in pieces if x not in known], " ", self.merger)
        self._merge([x for x in odd if x not in known], BETWEEN, self.tokenizer)
        for x, low in same:
            known[x] = known[low]
        for x, own in parts.items():
            known[x] = b"".join(map(known.__getitem__, own))

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        different, which = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        known = self.known
        if len(known) > CACHE:
            known.clear()
        own = list(map(known.get, different))
        new = [x for x, ids in zip(different, own, strict=True) if ids is None]
        if new:
            self._learn(new)
            own = [known[x] if ids is None else ids for x, ids in zip(different, own, strict=True)]
        ids = np.frombuffer(b"".join(own), np.uint32)
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        first, n = np.cumsum(size) - size, size[which]
        ends = np.append(0, np.cumsum(n))
        bounds = ends[np.append(0, np.cumsum(split.value_lengths().to_numpy()))].tolist()
        kind = np.int32 if max(len(ids), bounds[-1]) < 1 << 31 else np.int64
        from_ = (first[which] - ends[:-1]).astype(kind)
        del split, words, different, which, own, new, first, ends  # as large as what follows
        at = np.repeat(from_, n)
        at += np.arange(len(at), dtype=kind)
        ids = ids[at]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


_SHARED: dict[str, Words] = {}
KEPT["packing"] = _SHARED.clear


def shared_words(path: str) -> Words:
    """One for each worker process, so that its tasks after the first know the words of those before."""
    if path not in _SHARED:
        _SHARED[path] = Words(path)
    return _SHARED[path]


def best_cuts(at: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The cheapest ends of runs, among the rising positions `at` (0 first; the last is always an end)."""
    place = np.full(int(at[-1]) + 1, -1, np.int32)  # of each position among the ends
    place[at] = np.arange(len(at))
    to, start = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for s in POWERS:
        if s < length:
            j = np.flatnonzero(at >= s).astype(np.int32)
            i = place[at[j] - s]
            to.append(j[i >= 0])
            start.append(i[i >= 0])
    to, start = np.concatenate(to), np.concatenate(start)
    order = np.argsort(to, kind="stable")
    start, first = array("i", start[order].tobytes()), np.searchsorted(to[order], np.arange(len(at) + 1, dtype=np.int32)).tolist()
    del place, to, order
    p, pen, n = at.tolist(), penalty.tolist(), len(at)
    f, g, back = [0.0] * n, [0.0] * n, [0] * n
    queue, head = [0], 0
    for j in range(1, n):
        x = p[j]
        while p[queue[head]] < x - length:
            head += 1
        i = queue[head]
        best = g[i] + length - x
        for k in start[first[j] : first[j + 1]]:
            if f[k] < best:
                best, i = f[k], k
        f[j], back[j] = best + pen[j], i
        y = g[j] = f[j] + x
        while len(queue) > head and g[queue[-1]] >= y:
            queue.pop()
        queue.append(j)
    ends, j = [], n - 1
    while j > 0:
        ends.append(p[j])
        j = back[j]
    return np.array(ends[::-1], np.int64)


def candidates(ids: np.ndarray, starts: np.ndarray, stops: np.ndarray, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a run may end, and their penalties. starts: of the documents' parts."""
    total = len(ids)
    pen = np.full(total + 1, np.inf, np.float32)
    pen[::grid] = HARD
    pen[1:][np.isin(ids, stops)] = SENTENCE
    pen[starts] = 0
    pen[total] = 0
    at = np.flatnonzero(np.isfinite(pen))
    return at.astype(np.int64), pen[at]


def pack_chunk(parts: list[tuple], stops: np.ndarray, last: bool, length: int = LENGTH) -> tuple[list[tuple], list[tuple], int]:
    """Pieces (part, first, length, sequence, offset) of the parts (doc, doc_tokens, start, ids), what is left over, and the sequences."""
    sizes = np.array([len(x[3]) for x in parts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    ids = np.concatenate([x[3] for x in parts])
    ends = best_cuts(*candidates(ids, starts, stops, min(GRID, length)), length)
    begins = np.concatenate(([0], ends[:-1]))
    stop = len(ids) if last else int(begins[-1])
    first = np.union1d(begins, starts)
    first = first[first < stop]
    size = np.diff(np.append(first, stop))
    part = np.searchsorted(starts, first, "right") - 1
    run = np.searchsorted(begins, first, "right") - 1
    pieces = list(zip(part.tolist(), (first - starts[part]).tolist(), size.tolist(), run.tolist(), (first - begins[run]).tolist(), strict=True))
    rest = []
    if stop < len(ids):
        k = int(np.searchsorted(starts, stop, "right")) - 1
        skip = stop - int(starts[k])
        doc, tokens, start, own = parts[k]
        rest = [(doc, tokens, start + skip, own[skip:]), *parts[k + 1 :]]
    return pieces, rest, len(begins) - (not last)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """In parts of about SLICE bytes of text, or of one document."""
    size = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size) - size) // SLICE
    bounds = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        if a < b:
            yield batch.slice(a, b - a)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for."""
    path = tokenizer or default_tokenizer()
    docs = keep_columns(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sequence = shared_words(path), TaskContext.get().partitionId() << 36
        parts: list[tuple] = []
        held, id_type = 0, None

        def out(last: bool) -> pa.RecordBatch:
            nonlocal parts, held, sequence
            pieces, rest, n = pack_chunk(parts, words.stops, last, length)
            columns = [[] for _ in names]
            for k, first, size, run, offset in pieces:
                doc, tokens, start, ids = parts[k]
                own = ids[first : first + size]
                row = (doc, start + first, size, zlib.crc32(own.tobytes()), tokens, sequence + run, offset, own)
                for c, v in zip(columns, row, strict=False):
                    c.append(v)
            parts, held, sequence = rest, sum(len(x[3]) for x in rest), sequence + n
            kinds = [id_type, *[pa.int64()] * 6, *[pa.list_(pa.int32())] * with_ids]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            id_type = batch.column("doc_id").type
            for some in slices(batch):
                texts = pc.fill_null(some.column("text").cast(pa.large_string()), "")
                for doc, ids in zip(some.column("doc_id").to_pylist(), words.encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(END))
                    parts.append((doc, len(ids), 0, ids))
                    held += len(ids)
                    if held >= CHUNK:
                        yield out(False)
                give_back()
        if parts:
            yield out(True)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.mapInArrow(lean(pack, "packing"), schema)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
