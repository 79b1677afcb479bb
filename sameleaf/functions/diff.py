"""A token diff: what two texts have in common, its share, and both texts with it marked.

Tokens are runs of letters, digits and underscores of Latin scripts, and any other character alone.
White space between tokens is no token; it counts as common where a common token stands next to it, as
often as in the text with fewer of it. Of equally long alignments the one of Myers' greedy algorithm is
taken, deletions before insertions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

TOKEN = re.compile(r"[0-9A-Za-z_ª­ºÀ-ÖØ-öø-ˆˈ-˗˞-˿Ḁ-ỿ]+|\S")


def units(text: str) -> int:
    """Length in UTF-16 code units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m[0], *m.span()) for m in TOKEN.finditer(text)]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    n, m = len(a) - head, len(b) - head
    out = [(k, k) for k in range(head)]
    if not n or not m:
        return out
    reach, trace = {1: 0}, []
    for d in range(n + m + 1):
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            y = x - k
            while x < n and y < m and a[head + x] == b[head + y]:
                x, y = x + 1, y + 1
            reach[k] = x
            if x >= n and y >= m:
                break
        else:
            continue
        break
    x, y, pairs = n, m, []
    for d in range(len(trace) - 1, -1, -1):
        reach, k = trace[d], x - y
        before = k + 1 if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else k - 1
        px = reach[before] if d else 0
        py = px - before if d else 0
        while x > max(px, 0) and y > max(py, 0) and a[head + x - 1] == b[head + y - 1]:
            x, y = x - 1, y - 1
            pairs.append((head + x, head + y))
        x, y = px, py
    return out + pairs[::-1]


def _mark(text: str, parts: list[tuple[str, int, int]], common: set[int]) -> tuple[str, int]:
    """The text with common runs in <b>, and how much white space stands next to common tokens."""
    out, at, space, open_ = [], 0, 0, False
    for k, (_, s, e) in enumerate(parts):
        gap = text[at:s]
        near = k in common or k - 1 in common
        space += len(gap) if near else 0
        if gap and near and not open_:
            out.append("<b>")
            open_ = True
        if not gap and k in common and not open_:
            out.append("<b>")
            open_ = True
        if k not in common and open_:
            out += [gap, "</b>"]
            open_ = False
        else:
            out.append(gap)
        out.append(text[s:e])
        at = e
    rest = text[at:]
    if rest and len(parts) - 1 in common:
        space += len(rest)
    out.append(rest)
    if open_:
        out.append("</b>")
    return "".join(out), space


def diff(a: str, b: str) -> tuple[float, str, str]:
    """Similarity (common characters over the longer length), a marked, b marked."""
    longest = max(units(a), units(b))
    if not longest:
        return 1.0, "", ""
    ta, tb = tokens(a), tokens(b)
    pairs = align([t for t, _, _ in ta], [t for t, _, _ in tb])
    ma, sa = _mark(a, ta, {i for i, _ in pairs})
    mb, sb = _mark(b, tb, {j for _, j in pairs})
    return (sum(units(tb[j][0]) for _, j in pairs) + min(sa, sb)) / longest, ma, mb


def could_reach(a: str, b: str, threshold: float) -> bool:
    """False only where the diff can't reach the threshold: common tokens are common in the bags of tokens, too."""
    longest = max(units(a), units(b))
    ta, tb = Counter(TOKEN.findall(a)), Counter(TOKEN.findall(b))
    common = sum(min(n, tb[t]) * units(t) for t, n in ta.items() if t in tb)
    space = min(len(a) - sum(len(t) * n for t, n in ta.items()), len(b) - sum(len(t) * n for t, n in tb.items()))
    return common + space >= threshold * longest


def diff_udf(threshold: float):
    """similarity, a, b of two texts; null where the similarity can't reach the threshold."""

    @F.pandas_udf("similarity double, a string, b string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in parts:
            rows = [diff(a, b) if could_reach(a, b, threshold) else (None, None, None) for a, b in zip(left, right, strict=True)]
            yield pd.DataFrame(rows, columns=["similarity", "a", "b"])

    return run
