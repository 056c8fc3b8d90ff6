"""Periodic runs of words inside a text: seed-and-extend on diagonals.

A run is a stretch of consecutive words with smallest period q and at least max(MIN_LENGTH, 4 q)
words that no neighbouring word extends. On the diagonal of lag q (word i against word i + q) it is a
stretch of length - q equal words, so every lag class [2^t, 2^(t+1)) guarantees an overlap of
k = 3 * 2^t words (5 for lag 1). Per class the k-grams that recur in a document are indexed, pairs
of occurrences whose distance lies in the class are seeds, and a seed is extended both ways unless
the table of furthest covered positions per lag says that its stretch is known.

At most two pairs per occurrence are needed. A k-gram that recurs at a distance p below 2^t has
period p; if it also had period q of the class then, as p + q <= k, it would have period gcd(p, q)
(Fine and Wilf) and q would not be a run's smallest period, so such occurrences are no seeds of the
class. By the same argument no two recurrences lie closer than 2^t to each other, hence at most one
before lag q. Work is O(n log n) for n words, also for texts of one repeated word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import fresh

#: Fixed values of the definition: least words of a run, least number of its periods.
MIN_LENGTH, MIN_POWER = 6, 4
#: Words handled at once (a longer text is handled alone).
BLOCK_WORDS = 500_000

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("text", pa.string())])
SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


def _paired(first: np.ndarray, second: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, positions) of the grams made of ``first`` at i and ``second`` at i + gap, both known."""
    n = max(len(first) - gap, 0)
    at = np.flatnonzero((first[:n] >= 0) & (second[gap : gap + n] >= 0))
    keys = (first[at] << 32) | second[at + gap]
    order = np.argsort(keys, kind="stable")
    return keys[order], at[order]


def _doubled(rank: np.ndarray, size: int) -> np.ndarray:
    """Ranks of the grams of 2 * size words from those of size words; -1 where a gram does not recur."""
    keys, at = _paired(rank, rank, size)
    out = np.full(len(rank), -1, dtype=np.int64)
    if len(keys):
        group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
        again = np.bincount(group)[group] > 1
        out[at[again]] = group[again]
    return out


def _seeds(keys: np.ndarray, at: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, lag) of pairs of equal grams with a lag in [low, 2 low), by position."""
    found = []
    step = at[1:] - at[:-1]
    near = (keys[1:] == keys[:-1]) & (step >= low) & (step < 2 * low)
    found.append((at[:-1][near], step[near]))
    two = at[2:] - at[:-2]
    after = near[:-1] & (keys[2:] == keys[:-2]) & (two < 2 * low)
    found.append((at[:-2][after], two[after]))
    start, lag = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(start, kind="stable")
    return start[order], lag[order]


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix of two arrays of one length."""
    done, size = 0, 64
    while done < len(a):
        differ = np.flatnonzero(a[done : done + size] != b[done : done + size])
        if len(differ):
            return done + int(differ[0])
        done, size = done + size, size * 4
    return len(a)


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers (0 to 2^31)."""
    out, rank, n = [], {0: ids.astype(np.int64)}, len(ids)
    rank[1] = _doubled(rank[0], 1)
    rank[2] = _doubled(rank[1], 2)
    t = 0
    while (rank[t + 1] >= 0).any():
        low = 1 << t
        if t + 2 not in rank:
            rank[t + 2] = _doubled(rank[t + 1], 2 * low)
        keys, at = _paired(rank[2], rank[0], 4) if t == 0 else _paired(rank[t + 1], rank[t], 2 * low)
        known = 5 if t == 0 else 3 * low
        covered: dict[int, int] = {}
        for i, q in zip(*(x.tolist() for x in _seeds(keys, at, low))):
            if i < covered.get(q, 0):
                continue
            right = i + known + _agree(ids[i + known : n - q], ids[i + known + q :])
            left = i - _agree(ids[:i][::-1], ids[q : i + q][::-1])
            covered[q] = right
            if right + q - left >= max(MIN_LENGTH, MIN_POWER * q):
                out.append((left, right + q - left, q))
        t += 1
    return out


def _block(texts: list[bytes]) -> list[tuple[int, list, bytes]]:
    """(words, runs, collapsed text) of each text; a text's words get numbers of their own."""
    numbers, split = count(), [t.split() for t in texts]
    ids = [np.fromiter(map(defaultdict(numbers.__next__).__getitem__, ws), np.int64, len(ws)) for ws in split]
    begins = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    found: dict[int, list] = defaultdict(list)
    for start, length, period in runs(np.concatenate(ids)):
        d = int(np.searchsorted(begins, start, side="right")) - 1
        found[d].append((start - int(begins[d]), length, period))
    out = []
    for d, ws in enumerate(split):
        own = sorted(found.get(d, ()), key=lambda r: (r[0], r[2]))
        if own:
            keep = np.ones(len(ws), dtype=bool)
            for start, length, period in own:
                keep[start + period : start + length] = False
            kept = [ws[i] for i in np.flatnonzero(keep)]
        out.append((len(ws), own, b" ".join(kept if own else ws)))
    return out


def _blocks(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > 4 * BLOCK_WORDS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    keys = ("start", "length", "period")
    for batch in batches:
        texts = (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch)
        rows = [
            {"n_words": n, "runs": [dict(zip(keys, r)) for r in own], "text": kept.decode()}
            for part in _blocks(texts)
            for n, own, kept in _block(part)
        ]
        yield pa.array(rows, _FOUND)


def collapse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and, as last column, a struct (``periodic`` or a fresh name): n_words, runs, text.

    ``runs`` lists every run (start as word number, length, period) by start, then period; ``text``
    is the text's words joined by one space without those that a run contains after its first
    period. Words are maximal runs of other than ASCII white space. Null, empty and blank texts have no words, no
    runs and the empty text. Rows are judged alone: repeated rows give equal results, null ids and
    extra columns of any name pass through, an empty table gives no rows. One scan without a
    shuffle; a task holds BLOCK_WORDS words or one text.
    """
    found = F.arrow_udf(_find, SCHEMA)
    return docs.withColumn(fresh(docs, "periodic"), found(F.col(f"`{text_col}`").cast("binary")))
