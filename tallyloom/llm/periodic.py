"""Periodic runs of words: recursive frequency splitting, then a scan of all lags.

A run is a stretch of consecutive words with smallest period q and a length of at least
``max(LEAST, 3 * q)`` that no neighbouring word extends. Each of its words occurs three times in it, so a
word that occurs less than three times in its segment splits the segment; counts are taken anew in the
pieces until nothing changes, and pieces too short for a run go. All texts of a batch are split together.

What is left is scanned lag by lag. A run of lag q repeats at least ``max(LEAST - q, 2 * q)`` words in a row, so
its window of eight words is met at one of the places that are so many words apart; there the repeat is
measured to both ends by prefix sums, all places of many lags at once, and the words are compared at the end.

Null and empty texts have no words and no runs; null and repeated ids are kept row by row; texts and words
may be of any length; other columns are not read; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids as plain_ids
from .common import mix64, nullable

LEAST, TIMES = 24, 3  # fixed values of the definition: words of a run, periods of a run
WINDOW = 8  # words compared at a place at once; no repeat is shorter than 16
PLACES_AT_ONCE = 1 << 20
CHARS_AT_ONCE = 4_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)

Rewrite = Callable[[object, list[bytes]], list[bytes]]


def segments(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches that may hold runs; no stretch reaches over two owners."""
    at = np.arange(len(words))
    group = owner.astype(np.int64)
    while len(at):
        # pieces of consecutive places with the same group
        new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(group) != 0)))
        piece = np.cumsum(new) - 1
        key = piece * (int(words.max()) + 1) + words[at]
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        keep = (n[back] >= TIMES) & (np.bincount(piece)[piece] >= LEAST)
        if keep.all():
            starts = np.flatnonzero(new)
            return at[starts], np.concatenate((at[starts[1:] - 1], at[-1:])) + 1
        at, group = at[keep], piece[keep]
    return at, at


def _ahead(sums: np.ndarray, powers: np.ndarray, i: np.ndarray, q: np.ndarray, m: int) -> np.ndarray:
    """How many words from i on equal those q later, by prefix sums."""
    low, high = np.zeros(len(i), np.int64), m - i - q
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = (sums[i + mid] - sums[i]) * powers[q] == sums[i + q + mid] - sums[i + q]
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low


def _behind(sums: np.ndarray, powers: np.ndarray, i: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many words before i equal those q later."""
    low, high = np.zeros(len(i), np.int64), i.copy()
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = (sums[i] - sums[i - mid]) * powers[q] == sums[i + q] - sums[i + q - mid]
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low


def _plain_scan(words: np.ndarray) -> list[tuple[int, int, int]]:
    """Each lag compared word by word; only where sums of different words met."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // TIMES + 1):
        same = np.concatenate(([False], words[q:] == words[:-q], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for a, b in edge[edge[:, 1] - edge[:, 0] + q >= max(LEAST, TIMES * q)].tolist():
            found.setdefault((a, b + q), q)
    return [(a, b, q) for (a, b), q in found.items()]


def lag_scan(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs in one stretch of word numbers."""
    m = len(words)
    letters = mix64(words.astype(np.uint64) + np.uint64(1))
    powers = np.full(m + 1, BASE)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters * powers[:m])))
    window = (sums[WINDOW:] - sums[:-WINDOW]) * powers[m - WINDOW - np.arange(m - WINDOW + 1)]  # all on one scale

    found: dict[tuple[int, int], int] = {}
    lags = np.arange(1, m // TIMES + 1)
    step = np.maximum(LEAST - lags, 2 * lags) - WINDOW + 1  # a repeat that long covers a window at a multiple of it
    counts = (m - WINDOW - lags) // step + 1
    done = np.cumsum(counts)
    a = 0
    while a < len(lags):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + PLACES_AT_ONCE, side="right")))
        n = counts[a:b]
        q = np.repeat(lags[a:b], n)
        i = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * np.repeat(step[a:b], n)
        hit = window[i] == window[i + q]
        i, q = i[hit], q[hit]
        if len(i):
            left, right = i - _behind(sums, powers, i, q), i + q + _ahead(sums, powers, i, q, m)
            long = right - left >= np.maximum(LEAST, TIMES * q)
            for x in set(zip(left[long].tolist(), right[long].tolist(), q[long].tolist(), strict=True)):
                found[x[:2]] = min(x[2], found.get(x[:2], x[2]))  # multiples of the period reach as far
        a = b
    runs = [(s, e, q) for (s, e), q in found.items()]
    sure = all(np.array_equal(words[s : e - q], words[s + q : e]) for s, e, q in runs)
    return runs if sure else _plain_scan(words)


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, end, period) of the runs of each list of words, by start, then period."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = [w for t in texts for w in t]
    words = pd.factorize(np.fromiter(flat, object, len(flat)))[0].astype(np.int64)
    first = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(words):
        return out
    owner = np.repeat(np.arange(len(texts)), sizes)
    for s, e in zip(*(x.tolist() for x in segments(words, owner)), strict=True):
        k, at = int(owner[s]), s - int(first[owner[s]])
        out[k] += [(a + at, b + at, q) for a, b, q in lag_scan(words[s:e])]
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run repeats, joined by one space."""
    gone = np.zeros(len(words) + 1, np.int64)
    for s, e, q in runs:
        gone[s + q] += 1
        gone[e] -= 1
    return b" ".join(w for w, x in zip(words, np.cumsum(gone).tolist(), strict=False) if not x)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length for its period; ties: the first, then the shorter period."""
    best = None
    for s, e, q in runs:
        if best is None or (e - s) * best[2] > (best[1] - best[0]) * q:
            best = (s, e, q)
    return best


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """(``id_col``, runs array<struct<start, length, period>>, strongest struct or null, collapsed text) of every row.

    rewrite: what becomes of (id, words) before the search.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, pdf = plain_ids(pdf["id"]), nullable(pdf, kinds)
            held: list[list[bytes]] = []
            size = a = 0
            for k, text in enumerate(pdf["text"]):
                words = (text or "").encode("utf-8", "replace").split()
                held.append(rewrite(names[k], words) if rewrite else words)
                size += len(text or "")
                if size >= CHARS_AT_ONCE or k == len(pdf) - 1:
                    found = runs_of(held)
                    row = lambda r: {"start": r[0], "length": r[1] - r[0], "period": r[2]}
                    yield pd.DataFrame({
                        id_col: pdf["id"].iloc[a : k + 1].reset_index(drop=True), "runs": [list(map(row, x)) for x in found],
                        "strongest": [row(x) if (x := strongest(r)) else None for r in found],
                        "collapsed": [collapsed(w, r).decode("utf-8", "replace") for w, r in zip(held, found, strict=True)],
                    })
                    held, size, a = [], 0, k + 1

    kind = docs.schema[id_col].dataType.simpleString()
    kinds = {"id": kind}
    one = "struct<start: long, length: long, period: long>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"`{id_col}` {kind}, runs array<{one}>, strongest {one}, collapsed string")
