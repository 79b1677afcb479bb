"""Many texts against a few, in blocks: all cosines of a block are one product of matrices, all bags of tokens one count.

The sums are of whole numbers, so they are exact in double precision, and roots and quotients are those of
`text.cosine` and `text.in_range`; results don't depend on the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .diff import TOKEN, diff, units

#: Rows of a block of the many and of the few, and the cells that a block's matrix may have.
MANY, FEW, CELLS = 256, 1024, 1 << 23


def _code_units(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-16-le", "surrogatepass"), np.uint16)


class Lengths:
    """Texts by length, in UTF-16 code units."""

    def __init__(self, texts: list[str]):
        n = np.fromiter(map(units, texts), np.int64, len(texts))
        self.order = np.argsort(n, kind="stable")
        self.texts, self.units = [texts[k] for k in self.order], n[self.order]


class Block:
    """Some of the few: how often each has each code unit, and each token, for code units and tokens that occur here."""

    def __init__(self, texts: list[str], lengths: np.ndarray, at: int):
        self.texts, self.units, self.at = texts, lengths, at
        self.chars, self.alphabet = _code_units(texts), None
        self.n_chars = len(np.unique(self.chars))

    def characters(self) -> None:
        if self.alphabet is None:
            kinds = np.unique(self.chars)
            self.alphabet = np.full(1 << 16, len(kinds), np.int64)
            self.alphabet[kinds] = np.arange(len(kinds))
            self.matrix, self.root = self.counts(self.chars, self.units)

    def counts(self, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text its counts over this alphabet, and the root of the sum of all its squared counts."""
        rows, wide = np.repeat(np.arange(len(lengths)), lengths), self.n_chars + 1
        made = np.bincount(rows * wide + self.alphabet[chars], minlength=len(lengths) * wide).reshape(-1, wide)[:, :-1].astype(float)
        kinds, n = np.unique((rows << 16) + chars, return_counts=True)
        return made, np.sqrt(np.bincount(kinds >> 16, n.astype(float) ** 2, minlength=len(lengths)))

    def cosines(self, texts: list[str], lengths: np.ndarray) -> np.ndarray:
        self.characters()
        made, root = self.counts(_code_units(texts), lengths)
        return (made @ self.matrix.T) / (root[:, None] * self.root[None, :])

    def index(self, rows: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Where each token (by id, ascending) occurs, and how often."""
        self.ids, self.starts = np.unique(ids, return_index=True)
        self.ends = np.append(self.starts[1:], len(ids))
        self.rows, self.n = rows, n

    def common(self, rows: np.ndarray, ids: np.ndarray, n: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
        """Code units of common tokens, of each of size texts with each of this block."""
        at = np.searchsorted(self.ids, ids)
        known = (at < len(self.ids)) & (self.ids[np.minimum(at, len(self.ids) - 1)] == ids) if len(self.ids) else np.zeros(len(ids), bool)
        at, rows, ids, n = at[known], rows[known], ids[known], n[known]
        many = self.ends[at] - self.starts[at]
        upto, out = np.cumsum(many), np.zeros(size * len(self.texts))
        cuts = np.searchsorted(upto, np.arange(CELLS, upto[-1] if len(upto) else 0, CELLS))
        for s, e in zip([0, *cuts], [*cuts, len(many)], strict=True):
            m = many[s:e]
            place = np.arange(m.sum()) + np.repeat(self.starts[at[s:e]] - (np.cumsum(m) - m), m)
            shared = np.minimum(np.repeat(n[s:e], m), self.n[place]) * np.repeat(weight[ids[s:e]], m)
            out += np.bincount(np.repeat(rows[s:e], m) * len(self.texts) + self.rows[place], shared, minlength=len(out))
        return out.reshape(size, -1)


class Few:
    """The few texts, and the pairs that others make with them at a threshold t (0 < t <= 1)."""

    def __init__(self, texts: list[str], t: float, verify: str = "cosine"):
        self.t, self.verify = float(t), verify
        by = Lengths(texts)
        self.texts, self.units, self.blocks = by.texts, by.units, []
        for at in range(0, len(texts), FEW):
            self._block(at, min(at + FEW, len(texts)))
        self.exact = lru_cache(1 << 14)(diff)
        if verify == "diff":
            self.vocabulary: dict[str, int] = {}
            for b in self.blocks:
                rows, ids, n, b.space = self._tokens(b.texts, True)
                by_id = np.lexsort((rows, ids))
                b.index(rows[by_id], ids[by_id], n[by_id])
            self.weight = np.fromiter(map(units, self.vocabulary), np.int64, len(self.vocabulary))

    def _block(self, at: int, end: int) -> None:
        made = Block(self.texts[at:end], self.units[at:end], at)
        if end - at > 1 and (end - at) * made.n_chars > CELLS:
            self._block(at, (at + end) // 2)
            self._block((at + end) // 2, end)
        else:
            self.blocks.append(made)

    def _tokens(self, texts: list[str], learn: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, token and its number of known tokens, and how much of each text is no token."""
        known, found, sizes, space = self.vocabulary, [], [], []
        for text in texts:
            parts = TOKEN.findall(text)
            if learn:
                for x in parts:
                    known.setdefault(x, len(known))
            ids = [known[x] for x in parts if x in known]
            found += ids
            sizes.append(len(ids))
            space.append(len(text) - sum(map(len, parts)))
        wide = len(known) + 1
        keys, n = np.unique(np.repeat(np.arange(len(texts)), sizes) * wide + np.array(found, np.int64), return_counts=True)
        return keys // wide, keys % wide, n, np.array(space, np.int64)

    def _ratio(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ratio = a.astype(float)[:, None] / b.astype(float)[None, :]
        return (ratio >= self.t) & (ratio <= 2.0 - self.t)

    def near(self, lengths: np.ndarray) -> np.ndarray:
        """Whether there is any text of similar length."""
        kinds, back = np.unique(lengths, return_inverse=True)
        own = np.unique(self.units)
        return np.array([k > 0 and bool(self._ratio(np.array([k]), own).any()) for k in kinds], bool)[back]

    def pairs(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in texts (without empty ones), places in self.texts, and similarities of all pairs that qualify, in parts."""
        by = Lengths(texts)
        for start in range(0, len(texts), MANY):
            some, n, order = by.texts[start : start + MANY], by.units[start : start + MANY], by.order[start : start + MANY]
            tokens = None
            for b in self.blocks:
                if b.units[-1] < n[0] / (2.0 - self.t) - 1 or b.units[0] > n[-1] / self.t + 1:
                    continue
                ok = self._ratio(n, b.units)
                if not ok.any():
                    continue
                if self.verify == "diff":
                    tokens = tokens or self._tokens(some)
                    rows, ids, count, space = tokens
                    ok &= b.common(rows, ids, count, self.weight, len(some)) + np.minimum(space[:, None], b.space[None, :]) >= self.t * np.maximum(n[:, None], b.units[None, :])
                used = np.flatnonzero(ok.any(1))
                if not len(used):
                    continue
                cosine = b.cosines([some[k] for k in used], n[used])
                i, j = np.nonzero(ok[used] & (cosine >= self.t))
                if len(i):
                    yield order[used[i]], j + b.at, cosine[i, j]

    def alike(self, texts: list[str]) -> Iterator[tuple[int, int, float, str, str]]:
        """The same pair by pair, verified, with both texts marked if it was by diff."""
        for i, j, similarity in self.pairs(texts):
            for p, q, s in zip(i.tolist(), j.tolist(), similarity.tolist(), strict=True):
                if self.verify != "diff":
                    yield p, q, s, texts[p], self.texts[q]
                else:
                    s, a, b = self.exact(texts[p], self.texts[q])
                    if s >= self.t:
                        yield p, q, s, a, b

    def hit(self, texts: list[str]) -> np.ndarray:
        """Whether a text has any pair."""
        out = np.zeros(len(texts), bool)
        if self.verify != "diff":
            for i, _, _ in self.pairs(texts):
                out[i] = True
            return out
        for i, j, _ in self.pairs(texts):
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                out[p] = out[p] or self.exact(texts[p], self.texts[q])[0] >= self.t
        return out
