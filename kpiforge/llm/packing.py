"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of token ids; every window of ``WINDOW`` tokens is filled from the queues
in proportion to the sources' shares. What a source is owed (its deficit) is carried from window to
window, and from one partition of the queues to the next: partition p holds the tokens
[p T / P, (p + 1) T / P) of a queue of T tokens, so the schedule of a partition follows from the
totals of the sources alone and every task can compute the partitions that it needs.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kpiforge.llm.common import attach, cut, stored

WINDOW = 4096
END_ID = 2
#: A source's grant is at least this long unless its queue, the window or its share runs out.
LEAST_GRANT = 64
#: Tokens of one partition of the queues.
PARTITION_TOKENS = 1 << 22
#: Beyond this many sources, queues are groups of sources (by hash).
MAX_QUEUES = 4096
#: Encodings remembered by a Python worker, from task to task, in each of two generations, and spellings.
MAX_MEMO, MAX_SPELT = 3 << 17, 3 << 17
#: Longer words are encoded anew each time.
MEMO_BYTES = 64


#: The normalizers and the pieces of the tokenizers whose words are encoded one by one.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A word of these letters and then ASCII marks is (at most) two pieces, which normalizing only lower-cases.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßÿ"


def word_by_word(tokenizer) -> bool:
    """Whether the tokenizer drops white space and cuts words into PIECES, so that words can be encoded apart."""
    spec = json.loads(tokenizer.to_str())
    normalizers = (spec["normalizer"] or {}).get("normalizers", [])
    cutters = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if [n["type"] for n in normalizers] != NORMALIZERS or [c["type"] for c in cutters] != ["Split", "ByteLevel"]:
        return False
    split, level = cutters
    cuts = split["pattern"].get("Regex") == PIECES and split["behavior"] == "Removed" and split["invert"]
    return cuts and not level["add_prefix_space"] and not level["use_regex"] and spec["post_processor"] is None


class WordIds(dict):
    """Word -> its ids as bytes, for tokenizers that ``word_by_word`` accepts.

    Spellings of a word that differ in ASCII case or in end marks share one encoding. Pieces of plain words go
    to the tokenizer's model as they are; all other words take its whole way.
    """

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        self.model = self.tokenizer.model
        self.core: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {b"": b""}
        self.spelt = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in LETTERS}

    def __missing__(self, word: bytes) -> bytes:
        head = word.rstrip(MARKS)
        key = head.lower()
        out = self.core.get(key) or self._encoded(key, None)
        if out is None:  # not plain
            whole = b"\0" + word  # apart from the letters of plain words
            out = self.core.get(whole) or self._encoded(whole, word)
        elif len(head) < len(word):
            out += self._marked(word[len(head) :])
        if len(word) <= MEMO_BYTES:
            if len(self) >= MAX_SPELT:
                self.clear()
            self[word] = out
        return out

    def _encoded(self, key: bytes, word: bytes | None) -> bytes | None:
        """Ids of the letters ``key`` (None if it is something else), or of the whole ``word``, to be kept under ``key``."""
        out = self.old.get(key)
        if out is None:
            if word is not None:
                ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
            elif key.isalpha():  # ASCII letters are spelt as they are
                ids = [t.id for t in self.model.tokenize(key.decode())]
            elif PLAIN.fullmatch(text := key.decode("utf-8", "replace")):
                ids = [t.id for t in self.model.tokenize(text.lower().translate(self.spelt))]
            else:
                return None
            out = _ids_bytes(ids, self.dtype)
        if len(key) <= MEMO_BYTES:
            if len(self.core) >= MAX_MEMO:  # words in use move on to the next generation
                self.old, self.core = self.core, {}
            self.core[key] = out
        return out

    def _marked(self, marks: bytes) -> bytes:
        out = self.marks.get(marks)
        if out is None:
            # ASCII marks are spelt as they are
            out = _ids_bytes([t.id for t in self.model.tokenize(marks.decode())], self.dtype)
            if len(marks) <= MEMO_BYTES and len(self.marks) < MAX_SPELT:
                self.marks[marks] = out
        return out


def _ids_bytes(ids: list[int], dtype: str) -> bytes:
    code = array("H" if dtype == "<u2" else "I", ids)
    if sys.byteorder == "big":
        code.byteswap()
    return code.tobytes()


class TextIds:
    """Text -> its ids as bytes, by any tokenizer."""

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        self.words = WordIds(path, dtype) if word_by_word(self.tokenizer) else None

    def __call__(self, text: bytes) -> bytes:
        if self.words is not None:
            words = self.words
            return b"".join([words[w] for w in text.split()])
        ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, dtype=self.dtype).tobytes()


@lru_cache(maxsize=1)
def _memo(path: str, dtype: str) -> TextIds:
    return TextIds(path, dtype)


def tokenized(docs: DataFrame, path: str, id_col, text_col, queue, end_id=END_ID) -> DataFrame:
    """Stored rows (id, queue, part, before, n, ids): ids end with ``end_id`` and are 2 or 4 bytes each.

    ``part`` is the task that wrote the row, ``before`` the tokens of the queue before it in the part.
    """
    from tokenizers import Tokenizer

    dtype = "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    source = docs.select(F.col(id_col).alias("id"), queue.cast("string").alias("queue"), F.col(text_col).cast("binary").alias("t"))
    schema = source.drop("t").schema.add("part", "integer").add("before", "long").add("n", "long").add("ids", "binary")
    end = np.array([end_id], dtype=dtype).tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, encoded, filled = TaskContext.get().partitionId(), _memo(path, dtype), {}
        for b in batches:
            ids = [(encoded(t.as_buffer().to_pybytes()) if t.is_valid else b"") + end for t in b.column(2)]
            n = [len(x) // len(end) for x in ids]
            before = []
            for q, k in zip(b.column(1).to_pylist(), n):
                before.append(filled.get(q, 0))
                filled[q] = before[-1] + k
            cols = [b.column(0), b.column(1), pa.array([part] * len(n), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return stored(source.mapInArrow(run, schema)), dtype


class Schedule:
    """The grants of every partition, from the sources' totals (queues in a fixed order)."""

    def __init__(self, totals: list[int], partitions: int, window: int = WINDOW, least: int = LEAST_GRANT):
        self.totals, self.partitions, self.window, self.least = totals, partitions, window, least
        self.whole = sum(totals)
        self.of = lru_cache(maxsize=32)(self._grants)

    def start(self, p: int) -> list[int]:
        return [t * p // self.partitions for t in self.totals]

    def _grants(self, p: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Per queue: where in the queue its grants of partition p start, and where in the output."""
        begin, end = self.start(p), self.start(p + 1)
        at, stop = sum(begin), sum(end)
        left = np.array([e - b for b, e in zip(begin, end)], dtype=np.int64)
        taken = np.array(begin, dtype=np.int64)
        share = np.array(self.totals, dtype=np.float64) / max(self.whole, 1)
        owed = np.array([at * t / self.whole - b for t, b in zip(self.totals, begin)])
        queues, places, outs = [], [], []
        while at < stop:
            room = min(self.window - at % self.window, stop - at)
            owed += room * share
            want = np.minimum(np.floor(np.maximum(owed, 0)).astype(np.int64), left)
            want[(want < self.least) & (want < left)] = 0
            order = np.argsort(-owed, kind="stable")
            get = np.zeros_like(left)
            w = want[order]
            get[order] = np.clip(room - (np.cumsum(w) - w), 0, w)
            rest = room - int(get.sum())
            if rest:  # the queues that are owed most lend themselves to the rest of the window
                more = (left - get)[order]
                get[order] += np.clip(rest - (np.cumsum(more) - more), 0, more)
            for q in np.flatnonzero(get):
                queues.append(q)
                places.append(taken[q])
                outs.append(at)
                at += int(get[q])
            taken += get
            left -= get
            owed -= get
        queues, places, outs = map(np.array, (queues, places, outs))
        return {int(q): (places[queues == q], outs[queues == q]) for q in np.unique(queues)}

    def pieces(self, queue: int, begin: int, end: int):
        """(start in queue, length, place in the output) of the pieces of the queue's [begin, end)."""
        total = self.totals[queue]
        p = min(self.partitions - 1, begin * self.partitions // total)
        while p and total * p // self.partitions > begin:
            p -= 1
        while begin < end:
            stop = min(end, total * (p + 1) // self.partitions)
            if stop > begin:
                places, outs = self.of(p)[queue]
                i = int(np.searchsorted(places, begin, "right")) - 1
                while begin < stop:
                    last = stop if i + 1 == len(places) else min(stop, int(places[i + 1]))
                    yield begin, last - begin, int(outs[i]) + begin - int(places[i])
                    begin, i = last, i + 1
            p += 1


def _cells(at: int, length: int, whole: int, window: int):
    """(sequence, offset, length) of the output's [at, at + length); the last window is cut at powers of two."""
    full = whole // window * window
    while length:
        if at < full:
            seq, offset, size = at // window, at % window, window
        else:
            seq, offset, tail = full // window, at - full, whole - full
            while offset >= 1 << (tail.bit_length() - 1):
                offset -= 1 << (tail.bit_length() - 1)
                tail -= 1 << (tail.bit_length() - 1)
                seq += 1
            size = 1 << (tail.bit_length() - 1)
        n = min(length, size - offset)
        yield seq, offset, n
        at, length = at + n, length - n


def pack(
    docs: DataFrame, tokenizer: str, id_col="doc_id", text_col="text", source_col="source", window: int = WINDOW,
    partition_tokens: int = PARTITION_TOKENS, max_queues: int = MAX_QUEUES,
) -> DataFrame:
    """One row per piece: id, start, length, ids (4-byte little-endian), doc_tokens, sequence_id, offset.

    The shares are those of the sources' tokens, so all queues end together and every id lies in
    exactly one piece. Only the tokens after the last full window go to shorter sequences, each as
    long as a power of two. Null and empty texts are the end id alone, null sources form one queue,
    repeated rows are packed each; an empty table gives no pieces.
    """
    many = docs.select(F.coalesce(F.col(source_col), F.lit("")).alias("s")).distinct().count() > max_queues
    name = F.concat(F.lit("s"), F.col(source_col).cast("string"))
    queue = F.pmod(F.xxhash64(name), F.lit(max_queues)).cast("string") if many else F.coalesce(name, F.lit("null"))
    rows, dtype = tokenized(docs, tokenizer, id_col, text_col, queue)
    sums = cut(rows.groupBy("queue", "part").agg(F.sum("n").alias("n")))
    ahead = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(sums.select("queue", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")))
    totals = sorted((r[0], r[1]) for r in sums.groupBy("queue").agg(F.sum("n")).collect())  # max_queues rows at most
    index, counts = {q: i for i, (q, _) in enumerate(totals)}, [n for _, n in totals]
    whole = sum(counts)
    plan = counts, max(1, -(-whole // partition_tokens)), window
    located = attach(rows, bases, ["queue", "part"]).select("id", "queue", "n", (F.col("base") + F.col("before")).alias("at"), "ids")
    names = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    schema = rows.select("id").schema
    for c in names:
        schema = schema.add(c, "binary" if c == "ids" else "long")

    def run(batches):
        schedule = Schedule(*plan)
        for b in batches:
            out, which = [], []
            for i, (q, n, at, ids) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4)))):
                wide = np.frombuffer(ids, dtype=dtype).astype("<u4")
                for begin, length, place in schedule.pieces(index[q], at, at + n):
                    for seq, offset, k in _cells(place, length, whole, window):
                        out.append((begin - at, k, wide[begin - at : begin - at + k].tobytes(), n, seq, offset))
                        which.append(i)
                        begin += k
            cols = list(zip(*out)) or [()] * len(names)
            arrays = [pa.array(c, schema[x].dataType.typeName() == "binary" and pa.binary() or pa.int64()) for c, x in zip(cols, names)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), *arrays], names=schema.names)

    return located.mapInArrow(run, schema).withColumnRenamed("id", id_col)
