"""Secret scans: fixed patterns, and sliding-window Shannon entropy of candidate strings.

Candidates are the maximal runs of a character class. A window slides over a candidate; the sum of
c * log2(c) over its character counts is kept by adding the term of the character that enters and
taking off the one that leaves, so each step costs the same at any window size. Windows whose entropy
reaches the class's threshold, and which hold the kinds of characters that the class asks for,
are joined to spans. Spans that an allow-list pattern touches are suppressed, as are those inside a
span that a fixed pattern or a narrower class has already given.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import fresh

# Kinds, patterns, the group whose length counts, its least length.
BASE = (
    ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)


@dataclass(frozen=True)
class CharClass:
    """A class of characters with its window (characters), entropy threshold (bits per character) and needed kinds."""

    kind: str
    characters: str
    window: int
    bits: float
    digits: int = 1
    lower: int = 0
    upper: int = 0
    letters: int = 1


#: From the narrowest class to the widest.
CLASSES = (
    CharClass("hex_entropy", "0-9A-Fa-f", 20, 2.9, digits=3, letters=2),
    CharClass("alnum_entropy", "0-9A-Za-z", 20, 3.5, digits=3, letters=3),
    CharClass("base64_entropy", "0-9A-Za-z+/_=-", 20, 3.8, digits=1, lower=2, upper=2, letters=4),
)

#: What looks random and is no secret: place holders, digests named as such, UUIDs, inlined media, counting rows.
ALLOW = (
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|xxxx",
    r"(?i)\b(?:sha-?(?:1|224|256|384|512)|md5|crc32|etag|integrity|checksum|commit|rev)\b\W{1,3}[0-9A-Za-z+/=_-]+",
    r"(?i)\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b",
    r";base64,[0-9A-Za-z+/=]+",
    r"(?i)abcdefgh|ijklmnop|qrstuvwx|01234567|12345678|98765432",
)
#: Characters before a candidate that an allow-list pattern may look at.
CONTEXT = 32

_SCALE = 1 << 24
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SCHEMA = "array<struct<kind:string,start:long,end:long>>"


@lru_cache(maxsize=16)
def _terms(window: int) -> tuple[int, ...]:
    """c * log2(c) for c up to ``window`` in fixed point, so that sums do not drift."""
    return (0, *(round(c * math.log2(c) * _SCALE) for c in range(1, window + 1)))


def hot_spans(s: str, cls: CharClass) -> list[tuple[int, int]]:
    """Joined windows of ``s`` (characters of ``cls``) that reach the threshold; shorter strings have none."""
    w, terms = cls.window, _terms(cls.window)
    # entropy = log2(w) - sum / w
    most = math.floor((math.log2(w) - cls.bits) * w * _SCALE)
    counts, total, spans = dict.fromkeys(s, 0), 0, []
    digits = lower = 0
    for i, c in enumerate(s):
        k = counts[c]
        total += terms[k + 1] - terms[k]
        counts[c] = k + 1
        digits += "0" <= c <= "9"
        lower += "a" <= c <= "z"
        if i + 1 < w:
            continue
        upper = sum(counts[x] for x in counts if "A" <= x <= "Z") if total <= most else 0
        if (
            total <= most
            and digits >= cls.digits
            and lower >= cls.lower
            and upper >= cls.upper
            and lower + upper >= cls.letters
        ):
            if spans and spans[-1][1] >= i + 1 - w:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((i + 1 - w, i + 1))
        old = s[i + 1 - w]
        k = counts[old]
        total += terms[k - 1] - terms[k]
        counts[old] = k - 1
        digits -= "0" <= old <= "9"
        lower -= "a" <= old <= "z"
    return spans


class Scanner:
    """All spans of a text: ``(kind, start, end)`` in code points, by start, then kind as listed."""

    def __init__(self, classes: Sequence[CharClass] = CLASSES, allow: Sequence[str] = ALLOW):
        # A maximal run of one class is the leftmost match, so the least length can be part of the
        # pattern; an assignment that fails takes its characters with it and cannot be left out so.
        self.assign = re.compile(BASE[0][1], re.IGNORECASE | re.ASCII)
        self.plain = [(kind, re.compile(f"{p[:-1]}{{{least - (4 if kind == 'access' else 0)},}}")) for kind, p, _, least in BASE[1:]]
        self.long = re.compile(f"[{_joined(classes)}]{{{min(c.window for c in classes)},}}") if classes else None
        self.classes = [(c, re.compile(f"[{c.characters}]{{{c.window},}}")) for c in classes]
        self.allow = [re.compile(a) for a in allow]
        self.place = {k: i for i, k in enumerate([b[0] for b in BASE] + [c.kind for c in classes])}

    def base(self, text: str) -> list[tuple[str, int, int]]:
        found = []
        if ":" in text or "=" in text:
            _, _, group, least = BASE[0]
            found += [("assign", *m.span()) for m in self.assign.finditer(text) if m.end(group) - m.start(group) >= least]
        for kind, pattern in self.plain:
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
        return found

    def _allowed(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """Where allow-list patterns match in a candidate and the characters before it."""
        left = max(0, start - CONTEXT)
        return [(m.start() + left, m.end() + left) for a in self.allow for m in a.finditer(text[left:end])]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        found = {kind: [] for kind in self.place}  # per kind by start, without overlaps
        for kind, s, e in self.base(text):
            found[kind].append((s, e))
        for run in self.long.finditer(text) if self.long else ():
            allowed = None
            for cls, pattern in self.classes:
                for part in pattern.finditer(run.group()):
                    at = run.start() + part.start()
                    for s, e in hot_spans(part.group(), cls):
                        s, e = s + at, e + at
                        if any(_holds(spans, s, e) for spans in found.values()):
                            continue
                        if allowed is None:
                            allowed = self._allowed(text, *run.span())
                        if not any(x < e and y > s for x, y in allowed):
                            found[cls.kind].append((s, e))
        return sorted(((k, s, e) for k, spans in found.items() for s, e in spans), key=lambda f: (f[1], self.place[f[0]]))


def _holds(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the ordered spans holds [start, end)."""
    i = bisect_right(spans, (start, math.inf))
    return i > 0 and spans[i - 1][1] >= end


def _joined(classes: Sequence[CharClass]) -> str:
    """A character set that holds every class; a hyphen that stands for itself goes last."""
    sets = [c.characters for c in classes]
    bare = "".join(s[:-1] if s.endswith("-") else s for s in sets)
    return bare + ("-" if any(s.endswith("-") for s in sets) else "")


def scan(docs: DataFrame, text_col: str = "text", classes=CLASSES, allow=ALLOW) -> DataFrame:
    """``docs`` and, as last column, ``secrets`` (or a fresh name): an array of (kind, start, end).

    Positions are code points of the whole text, the end is exclusive; spans are ordered by start,
    then by kind as listed in BASE and ``classes``. Spans of different kinds may overlap, except that entropy spans
    inside another span are left out. Null and empty texts have none. Rows are judged alone: repeated rows
    give equal results, null ids and extra columns of any name pass through, an empty table gives no rows.
    One scan without a shuffle; work is linear in the text.
    """

    def run(batches):
        scanner, keys = Scanner(classes, allow), ("kind", "start", "end")
        for batch in batches:
            rows = [[dict(zip(keys, s)) for s in scanner.spans(t)] if t else [] for t in batch.to_pylist()]
            yield pa.array(rows, pa.list_(_SPAN))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(fresh(docs, "secrets"), F.arrow_udf(run, SCHEMA)(F.col(f"`{text_col}`").cast("string")))
