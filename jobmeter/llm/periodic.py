"""Periodic runs of words: a passage that repeats itself at least four times in a row.

A run with smallest period q holds each of its words at least four times. A word that occurs less
often within the stretch of text at hand can therefore be in no run of it, and splits it. The pieces
are looked at again, with their own frequencies, until none falls apart; prose has nothing left by
then. What survives is compared with itself at a lag.

Lags up to 64 are all tried. A longer lag q is tried only if some stretch of more than 2q words,
on a grid, comes again q words later; every run has such a stretch, so none is missed, and a text of
any length costs about n log n instead of the square.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmeter.llm import words
from jobmeter.llm.tables import bounded_batches, col, ordered, packed, unpacked

REPEATS = 4  # times a period must fit into its run
SHORTEST = 6  # words of a run, at least
DIRECT_LAGS = 64
_BASE = np.uint64(0xD6E8FEB86659FD93)
_RUNS = T.ArrayType(
    T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False
)
_ARROW_RUNS = pa.list_(pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")]))


def segments(codes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (from, to) that may hold a run: each of their words occurs in them often enough.

    ``codes`` are the words of several texts, ``bounds`` the first word of each text and the end.
    """
    place = np.arange(len(codes))
    piece = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    stable = []
    while len(place):
        order = np.lexsort((codes[place], piece))
        c, p = codes[place][order], piece[order]
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (p[1:] != p[:-1])
        starts = np.flatnonzero(new)
        often = np.empty(len(c), bool)
        often[order] = np.repeat(np.diff(np.append(starts, len(c))) >= REPEATS, np.diff(np.append(starts, len(c))))
        split = np.zeros(int(piece[-1]) + 1, bool)
        split[piece[~often]] = True
        whole = ~split[piece]
        # Pieces that lost no word are done; the others fall apart where a word went.
        done = np.flatnonzero(whole)
        if len(done):
            cut = np.flatnonzero(np.diff(piece[done])) + 1
            stable += [(int(place[g[0]]), int(place[g[-1]]) + 1) for g in np.split(done, cut)]
        keep = often & ~whole
        place, piece = place[keep], piece[keep]
        if not len(place):
            break
        new = np.ones(len(place), bool)
        new[1:] = (np.diff(place) > 1) | (np.diff(piece) > 0)
        piece = np.cumsum(new) - 1
        long = np.bincount(piece)[piece] >= SHORTEST
        place, piece = place[long], piece[long]
    return [(a, b) for a, b in stable if b - a >= SHORTEST]


def lags(codes: np.ndarray) -> list[int]:
    """Every lag that is the smallest period of a run of ``codes``, and perhaps some more.

    For lags from low to high (a quarter more) windows of 2 * high words are hashed. A run of period
    q has at least 4q words, so that one of the windows that begin at the multiples of low // 2 lies in
    its first 3q words; the next window like it begins q later, as q is the window's own period.
    """
    n = len(codes)
    found = set(range(1, min(DIRECT_LAGS, n // REPEATS) + 1))
    low = DIRECT_LAGS + 1
    if low <= n // REPEATS:
        value = words.mix(codes.astype(np.uint64) + np.uint64(1))
        power = np.full(n, _BASE)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(value * power, out=total[1:])
    while low <= n // REPEATS:
        high = low + low // 4
        width, step = 2 * high, low // 2
        if width < n:
            # Scaled to a common power instead of divided by their own.
            window = (total[width:] - total[:-width]) * power[::-1][: n - width + 1]
            order = np.argsort(window, kind="stable")
            again = np.full(len(window), 0)
            same = window[order][1:] == window[order][:-1]
            again[order[:-1][same]] = (order[1:] - order[:-1])[same]
            gap = again[::step]
            found |= set(np.unique(gap[(gap >= low) & (gap <= high)]).tolist())
        low = high + 1
    return sorted(q for q in found if REPEATS * q <= n)


def runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal run of ``codes``, by start and period."""
    found: dict[tuple[int, int], int] = {}
    for q in lags(codes):
        differ = np.flatnonzero(codes[q:] != codes[:-q])
        edge = np.concatenate([[-1], differ, [len(codes) - q]])
        equal = np.diff(edge) - 1
        for i in np.flatnonzero(equal + q >= max(SHORTEST, REPEATS * q)):
            # Where a smaller period fits the whole stretch it is the same stretch, found before.
            found.setdefault((int(edge[i]) + 1, int(equal[i]) + q), q)
    return sorted(((start, length, q) for (start, length), q in found.items()), key=lambda r: (r[0], r[2]))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for given in batches:
        for first, data, bounds in words.slices(given["text"]):
            raw = data.tobytes()
            texts = [raw[a:b].split() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            start = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
            codes = np.empty(start[-1], np.int64)
            for t, a, b in zip(texts, start[:-1].tolist(), start[1:].tolist()):
                code: dict[bytes, int] = {}
                codes[a:b] = [code.setdefault(w, len(code)) for w in t]
            held: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for a, b in segments(codes, start):
                row = int(np.searchsorted(start, a, "right")) - 1
                shift = a - int(start[row])
                held[row] += [(shift + s, length, q) for s, length, q in runs(codes[a:b])]
            for row, found in enumerate(held):
                if found:
                    found.sort(key=lambda r: (r[0], r[2]))
                    gone = np.zeros(len(texts[row]) + 1, np.int64)
                    for s, length, q in found:
                        gone[s + q] += 1
                        gone[s + length] -= 1
                    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                    texts[row] = [texts[row][i] for i in kept]
            part = given.slice(first, len(texts))
            names = ("start", "length", "period")
            yield pa.RecordBatch.from_arrays(
                [
                    part["row"],
                    pa.array([[dict(zip(names, r)) for r in h] for h in held], _ARROW_RUNS),
                    pa.array([b" ".join(t).decode() for t in texts], pa.string()),
                ],
                names=["row", "runs", "collapsed"],
            )


def find_runs(docs: DataFrame, *, text: str = "text", keep: Iterable[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, else all) with ``runs`` and ``collapsed``.

    Words are runs of other characters than ``[\\x20\\x09-\\x0D]`` and compare as they are. A run
    (start, length, period) is a stretch of consecutive words in which words ``period`` apart are
    equal, with its smallest period, of at least max(6, 4 * period) words and as long as the text
    allows; ``runs`` lists them by start and period. ``collapsed`` are the words, joined by one blank,
    that no run contains after its first period.

    Every row is judged by its own text, so repeated rows agree. A null or empty text has no run and
    an empty ``collapsed``; an empty table gives an empty one. Columns of the caller called ``runs`` or
    ``collapsed`` are replaced.
    """
    keep = docs.columns if keep is None else list(keep)
    keyed = packed(bounded_batches(docs), keep, text=col(text).cast("string"))
    schema = T.StructType([keyed.schema["row"], T.StructField("runs", _RUNS), T.StructField("collapsed", T.StringType())])
    found = keyed.mapInArrow(_found, schema)
    return ordered(
        unpacked(found, keep, {"runs": F.col("runs"), "collapsed": F.col("collapsed")}), keep, "runs", "collapsed"
    )
