"""Suffix-array dedup: a distributed merge sort of suffixes that knows common prefixes.

A byte goes if it lies in a ``WINDOW``-byte string that starts anywhere else too. Only some suffixes
have to be sorted: of the GRAM-byte strings in a window the one of least hash is its anchor, so equal windows
have their anchor at the same place, and only anchors whose string occurs again can matter.

1. Blocks of documents find their anchors; hashes of the anchor strings are compared between blocks.
2. Each block sorts the suffixes at its recurring anchors into runs, front-coded (length of the prefix
   shared with the suffix before, and the rest), one run for each range of hashes.
3. A range's runs are exchanged and merged by a loser tree. It compares two suffixes only from the prefix
   that both are known to share with the last one put out, and it yields the shared prefix length of
   neighbours. Suffixes that share an anchor string form a group; each window of a member is looked up in it.
   The suffixes of anchors with more than ``GROUP_MAX`` occurrences are dealt by their block instead, over as many
   runs' ranges as they need, and all their windows are counted by Spark.
4. The verdicts (one bit per window) go back to the blocks, which cut the covered bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.bytescan import hashes, mixed, running, texts_of
from kpiforge.llm.common import released, stored

WINDOW = 200
#: Text bytes of a block; bytes of all texts for one range of hashes, and the most ranges.
BLOCK = 1 << 23
RANGE_BYTES = 1 << 23
MAX_RANGES = 1 << 14
#: Members of a group that one task compares; the windows of larger groups are counted by Spark.
GROUP_MAX = 50_000
#: Up to this many members, a group is compared pair by pair from its prefix lengths.
PAIRS_MAX = 12
#: The marks of recurring anchors are broadcast up to this many bytes, beyond that they are shuffled.
BROADCAST_BYTES = 32 << 20
#: Bytes after which an Arrow batch between the JVM and Python is full: blocks, which are larger, go one by one.
BATCH_BYTES = 4 << 20
#: Anchors whose suffixes a block sorts at once, if no run has more, and members of a group whose windows go to Spark at once.
PIECE, LATE_MAX = 1 << 14, 1 << 11
#: Parquet's writer looks at the size of what it holds after each row at first, not after a hundred (blocks).
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
_SLICE = 1 << 18


def _slices(lengths: np.ndarray):
    """Runs [i, j) of documents of about _SLICE bytes."""
    i, size = 0, 0
    for j, n in enumerate(lengths.tolist()):
        size += n
        if size >= _SLICE:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(lengths):
        yield i, len(lengths)


def anchors(data: np.ndarray, lengths: np.ndarray, window: int):
    """(anchor, first window, last window, hash of the anchor string) in joined documents, in order."""
    gram, span = window // 2, window - window // 2 + 1
    n, size = len(data), len(data) - window + 1
    if size <= 0:
        return np.zeros((3, 0), dtype=np.int64), np.zeros(0, dtype=np.uint64)
    prefix = running(data)
    start = np.arange(n - gram + 1)
    h = hashes(prefix, start, start + gram)
    bits = np.uint64(max(1, n.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = (h & ~low) | (low - start.astype(np.uint64))  # equal hashes: the last one wins
    least, width = key, 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = (low - (least[:size] & low)).astype(np.int64)
    stop = np.cumsum(lengths)
    inside = np.ones(size, dtype=bool)  # windows that do not cross documents
    for e in stop.tolist():
        inside[max(0, e - window + 1) : e] = False
    first = np.concatenate([[True], at[1:] != at[:-1]]) & inside
    first |= np.concatenate([[True], ~inside[:-1]]) & inside
    s0 = np.flatnonzero(first)
    ends = np.flatnonzero(inside & np.concatenate([first[1:] | ~inside[1:], [True]]))
    return np.array([at[s0], s0, ends]), mixed(h[at[s0]])  # anchors have small hashes; ranges need even ones


class _Block:
    """Documents of a block: joined bytes, and anchors by place in them."""

    def __init__(self, ids: list, texts: list[bytes], window: int):
        self.ids, self.window = ids, window
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.data = b"".join(texts)
        raw, begin = np.frombuffer(self.data, dtype=np.uint8), np.concatenate([[0], np.cumsum(self.lengths)])
        where, found = [np.zeros((3, 0), dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        for i, j in _slices(self.lengths):
            a, h = anchors(raw[begin[i] : begin[j]], self.lengths[i:j], window)
            where.append(a + begin[i])
            found.append(h)
        self.where, self.hash = np.concatenate(where, axis=1), np.concatenate(found)
        self.known, self.index, self.count = np.unique(self.hash, return_inverse=True, return_counts=True)


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def shared(a: bytes, b: bytes, start: int) -> int:
    """The length of the common prefix of two strings that share at least ``start`` bytes."""
    step, at, n = 8, start, min(len(a), len(b))
    while at < n and a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    while step > 1 and at < n:
        step //= 2
        if a[at : at + step] == b[at : at + step]:
            at += step
    return min(at, n)


class Run:
    """A sorted run of suffixes, front-coded, with the bytes before each suffix and a repeat mark."""

    FIELDS = ("lcp", "rest_len", "rest", "left_len", "left", "many")

    def __init__(self, lcp: bytes, rest_len: bytes, rest: bytes, left_len: bytes, left: bytes, many: bytes):
        self.lcp, self.rest_len, self.rest, self.left_len, self.left, self.many = lcp, rest_len, rest, left_len, left, many

    @classmethod
    def of(cls, records: list[tuple[bytes, bytes, bool]]):
        """From sorted (suffix, left, many)."""
        lcp, rest, before = [], [], b""
        for suffix, _, _ in records:
            n = shared(before, suffix, 0)
            lcp.append(n)
            rest.append(suffix[n:])
            before = suffix
        lefts = [r[1] for r in records]
        return cls(bytes(lcp), bytes(map(len, rest)), b"".join(rest), bytes(map(len, lefts)), b"".join(lefts), bytes(r[2] for r in records))

    def fields(self) -> list[bytes]:
        return [getattr(self, f) for f in self.FIELDS]

    def suffixes(self) -> Iterator[tuple[int, bytes]]:
        at, last = 0, b""
        for n, k in zip(self.lcp, self.rest_len):
            last = last[:n] + self.rest[at : at + k]
            at += k
            yield n, last

    def lefts(self) -> Iterator[bytes]:
        at = 0
        for k in self.left_len:
            yield self.left[at : at + k]
            at += k


def merge(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, bytes, int]]:
    """(prefix shared with the one before, suffix, run) in order, by a loser tree.

    A contender's ``lcp`` is what it shares with the last suffix put out: the one with more is less, and
    only equal ones are compared, from there on. The suffix that follows the winner in its run
    brings that number along, so no known prefix is compared again.
    """
    k = len(runs)
    lcp, head = [0] * k, [b""] * k
    alive = [False] * k

    def pull(r: int) -> None:
        got = next(runs[r], None)
        alive[r] = got is not None
        lcp[r], head[r] = got if got else (-1, b"")

    def beats(a: int, b: int) -> bool:
        """Whether a comes first; the loser's lcp is then what it shares with the winner."""
        if lcp[a] != lcp[b]:
            return lcp[a] > lcp[b]
        if not alive[a]:
            return False
        n = shared(head[a], head[b], lcp[a])
        x, y = head[a], head[b]
        first = x[n:] < y[n:] or (len(x) == n and len(y) == n and a < b)
        lcp[b if first else a] = n
        return first

    for r in range(k):
        pull(r)
        if alive[r]:
            lcp[r] = 0
    losers = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        won = beats(a, b)
        losers[node] = b if won else a
        return a if won else b

    top = build(1) if k > 1 else 0
    while k and alive[top]:
        yield lcp[top], head[top], top
        pull(top)
        node = (top + k) // 2
        while node:
            if beats(losers[node], top):
                losers[node], top = top, losers[node]
            node //= 2


def _pair_bits(group: list, window: int) -> np.ndarray:
    """Group: (lcp with the member before, suffix, left, many, ...). Row per member, column per window offset."""
    width = window - window // 2 + 1
    bits = np.zeros((len(group), width), dtype=bool)
    for x in range(len(group)):
        right = window
        for y in range(x + 1, len(group)):
            right = min(right, group[y][0])
            a, b = group[x][2][::-1], group[y][2][::-1]
            left = shared(a, b, 0)
            if left + right >= window:
                bits[x, window - right : left + 1] = True
                bits[y, window - right : left + 1] = True
    return bits


def _window_hashes(group: list, window: int) -> np.ndarray:
    """Per member and window offset the 64-bit hash of the window, 0 where the member has no such window."""
    half, width = window // 2, window - window // 2 + 1
    out = np.zeros((len(group), width), dtype=np.uint64)
    for a in range(0, len(group), 1024):
        own = group[a : a + 1024]
        rows, cols = len(own), window + half + 1
        table = np.zeros((rows, cols), dtype=np.uint8)
        have = np.zeros((rows, width), dtype=bool)
        for i, g in enumerate(own):
            s, left = g[1], g[2]
            table[i, width - 1 - len(left) : width - 1] = np.frombuffer(left, np.uint8)
            table[i, width - 1 : width - 1 + len(s)] = np.frombuffer(s, np.uint8)
            have[i, window - len(s) : len(left) + 1] = True
        prefix = running(table.reshape(-1))
        start = (np.arange(rows) * cols)[:, None] + (width - 1 - np.arange(width))[None, :]
        h = hashes(prefix, start.reshape(-1), np.minimum(start.reshape(-1) + window, rows * cols))
        out[a : a + 1024] = mixed(h.reshape(rows, width) + np.arange(width, dtype=np.uint64)[None, :]) | np.uint64(1)
        out[a : a + 1024][~have] = 0
    return out


def _group_bits(group: list, window: int) -> np.ndarray:
    if len(group) <= PAIRS_MAX:
        bits = _pair_bits(group, window)
    else:
        h = _window_hashes(group, window)
        bits = np.zeros(h.shape, dtype=bool)
        for i in range(h.shape[1]):
            rows = np.flatnonzero(h[:, i])
            _, inverse, counts = np.unique(h[rows, i], return_inverse=True, return_counts=True)
            bits[rows, i] = counts[inverse] > 1
    for x, (_, suffix, left, many, *_rest) in enumerate(group):
        if many:
            bits[x, window - len(suffix) : len(left) + 1] = True
    return bits


def _block_runs(data: bytes, a: np.ndarray, s0: np.ndarray, s1: np.ndarray, part: np.ndarray, record: np.ndarray, window: int) -> Iterator[list[tuple[int, Run]]]:
    """The runs of a block's anchors by part, in lists of about PIECE anchors; ``record`` gets each anchor's place in its run."""
    order = np.argsort(part, kind="stable")
    begins = np.flatnonzero(np.diff(part[order], prepend=-1))
    stops = np.append(begins[1:], len(order))
    x = 0
    while x < len(begins):
        y = max(x + 1, int(np.searchsorted(stops, begins[x] + PIECE, side="right")))
        known: dict[tuple, list] = {}
        own = order[begins[x] : stops[y - 1]]
        for i, p, at, f, e in zip(own.tolist(), part[own].tolist(), a[own].tolist(), s0[own].tolist(), s1[own].tolist()):
            known.setdefault((p, data[at : e + window], data[f:at]), []).append(i)
        by_part: dict[int, list] = {}
        for key in sorted(known):
            records = by_part.setdefault(key[0], [])
            record[known[key]] = len(records)
            records.append((key[1], key[2], len(known[key]) > 1))
        del known
        yield [(p, Run.of(r)) for p, r in by_part.items()]
        x = y


def _by_block(blocks: DataFrame, back: DataFrame, size) -> DataFrame:
    """Left join of the blocks with a bit per anchor; its size is measured, and it is broadcast or shuffled."""
    total = back.agg(F.sum(size)).first()[0] or 0
    return blocks.join(F.broadcast(back) if total <= BROADCAST_BYTES else back.hint("merge"), "block", "left")


def dedup(
    docs: DataFrame, id_col="doc_id", text_col="text", window: int = WINDOW, block: int = BLOCK,
    range_bytes: int = RANGE_BYTES, group_max: int = GROUP_MAX,
) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end of each removed run).

    Texts are UTF-8 bytes, null counts as empty; texts shorter than the window lose nothing. Strings
    are judged on the input, within one text or between two, never across their edges; repeated rows are
    texts of their own, so rows at least as long as the window go whole. Anchors and the windows of large groups are told apart by
    64-bit hashes. An empty table gives no rows.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ranges = max(1, min(MAX_RANGES, -(-size // range_bytes)))
    half, width = window // 2, window - window // 2 + 1
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    schema = f"kind string, block string, range int, a binary, b binary, ids array<struct<v:{kind}>>, c binary"

    def read(batches):
        from pyspark import TaskContext

        task, n, ids, texts, filled = TaskContext.get().partitionId(), 0, [], [], 0
        names = ["kind", "block", "range", "a", "b", "ids", "c"]

        def flush():
            own = _Block(ids, texts, window)
            types = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.struct([("v", id_type)])), pa.binary()]
            rows = [("docs", f"{task}-{n}", -1, own.data, own.lengths.tobytes(), [{"v": i} for i in ids], own.where.astype(np.int32).tobytes() + own.index.astype(np.int32).tobytes())]
            r = _range(own.known, ranges)
            cuts = np.flatnonzero(np.diff(np.concatenate([[-1], r, [ranges]])))
            for x, y in zip(cuts[:-1], cuts[1:]):
                rows.append(("grams", f"{task}-{n}", int(r[x]), own.known[x:y].tobytes(), own.count[x:y].astype(np.int32).tobytes(), [], b""))
            for row in rows:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for b in batches:
            id_type = b.schema.field(0).type
            for i, t in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                ids.append(i)
                texts.append(t)
                filled += len(t) + 16
                if filled >= block:
                    yield from flush()
                    n, ids, texts, filled = n + 1, [], [], 0
        if ids:
            yield from flush()

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    table = stored(source.mapInArrow(read, schema), by="kind", options=LARGE_ROWS)
    grams = table.where("kind = 'grams'").select("block", "range", "a", "b")
    blocks = table.where("kind = 'docs'").select("block", "a", "b", "ids", "c")

    def recurring(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        known = [np.frombuffer(a, np.uint64) for a in rows["a"]]
        own = np.concatenate([np.frombuffer(b, np.int32) for b in rows["b"]])
        _, inverse = np.unique(np.concatenate(known), return_inverse=True)
        total = np.bincount(inverse, weights=own)[inverse]
        ends = np.cumsum([len(k) for k in known])[:-1]
        bits = [np.packbits(x > 1).tobytes() for x in np.split(total, ends)]
        hot = [np.packbits(x > group_max).tobytes() if (x > group_max).any() else b"" for x in np.split(total, ends)]
        spread = [int(x.sum()) for x in np.split(np.where(total > group_max, own, 0), ends)]
        return pd.DataFrame({"block": rows["block"], "part": key[0], "n": [len(k) for k in known], "bits": bits, "hot": hot, "spread": spread})

    marked = stored(grams.groupBy("range").applyInPandas(recurring, "block string, part int, n int, bits binary, hot binary, spread long"))
    salts = max(1, -(-(marked.agg(F.sum("spread")).first()[0] or 0) // group_max))
    marks = marked.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "n", "bits", "hot"))).alias("back"))

    run_schema = "kind string, block string, range int, " + ", ".join(f"{f} binary" for f in Run.FIELDS)

    def runs(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                where, index = _anchors_of(r.c)
                again = np.concatenate([np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]) for x in (r.back if r.back is not None else [])] or [np.zeros(0, np.uint8)])
                chosen = np.flatnonzero(again[index]) if len(again) else np.zeros(0, np.int64)
                a, s0, s1 = where[:, chosen]
                # the range of a gram from its place among the block's distinct ones
                part_of = np.repeat([x["part"] for x in (r.back if r.back is not None else [])], [x["n"] for x in (r.back if r.back is not None else [])])
                part = part_of[index[chosen]] if len(chosen) else np.zeros(0, np.int64)
                if len(chosen) and any(x["hot"] for x in r.back):
                    hot = np.concatenate([np.unpackbits(np.frombuffer(x["hot"] or bytes(len(x["bits"])), np.uint8), count=x["n"]) for x in r.back])
                    part = np.where(hot[index[chosen]], ranges + zlib.crc32(r.block.encode()) % salts, part)
                record = np.zeros(len(chosen), dtype=np.int32)
                names = ["kind", "block", "range", *Run.FIELDS]
                for found in _block_runs(r.a, a, s0, s1, part, record, window):
                    yield pd.DataFrame([("runs", r.block, p, *x.fields()) for p, x in found], columns=names)
                refs = ("refs", r.block, -1, a.astype(np.int32).tobytes(), part.astype(np.int32).tobytes(), record.tobytes(), b"", b"", b"")
                yield pd.DataFrame([refs], columns=names)

    exchanged = stored(_by_block(blocks.select("block", "a", "c"), marks, F.size("back") * 56 + F.aggregate("back", F.lit(0), lambda s, x: s + F.length(x["bits"]) + F.length(x["hot"]))).mapInPandas(runs, run_schema), by="kind", options=LARGE_ROWS)
    released(table, only="kind=grams")
    released(marked)

    columns = ["block", "part", "bits", "window", "record", "offset"]

    def decide(part: int, names: list[str], held: list[Run]) -> Iterator[pd.DataFrame]:
        lefts = [h.lefts() for h in held]
        verdict = [np.zeros((len(h.lcp), width), dtype=bool) for h in held]
        hot = part >= ranges  # the other members of a group may lie in other parts
        at, group, deferring = [0] * len(held), [], hot

        def close() -> list[tuple]:
            """Judges the group, or, of one that is too large, passes its windows on."""
            late = []
            if deferring and group:
                h = _window_hashes(group, window)
                run, n = np.array([g[4] for g in group]), np.array([g[5] for g in group])
                for x in np.unique(run):
                    mine = np.flatnonzero(run == x)
                    m, o = np.nonzero(h[mine])
                    late.append((names[x], part, b"", h[mine][m, o].view(np.int64), n[mine][m], o))
            if deferring or len(group) == 1:
                for g in group:
                    if g[3]:
                        verdict[g[4]][g[5], window - len(g[1]) : len(g[2]) + 1] = True
            elif group:
                for g, b in zip(group, _group_bits(group, window)):
                    verdict[g[4]][g[5]] |= b
            group.clear()
            return late

        for lcp, suffix, r in merge([h.suffixes() for h in held]):
            apart = lcp < half and not hot  # windows of a hot part are counted whatever group they are in
            if apart or len(group) >= (min(group_max, LATE_MAX) if deferring else group_max):
                deferring = deferring or not apart
                late = close()
                if late:
                    yield pd.DataFrame(late, columns=columns)
                deferring = hot or lcp >= half
            n = at[r]
            at[r] += 1
            group.append((lcp, suffix, next(lefts[r]), held[r].many[n], r, n))
        late = close()
        late += [(names[r], part, np.packbits(v, axis=1).tobytes() if v.any() else b"", None, None, None) for r, v in enumerate(verdict)]
        yield pd.DataFrame(late, columns=columns)

    def decided(frames):
        part, names, held = None, [], []
        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.range != part:
                    if held:
                        yield from decide(part, names, held)
                    part, names, held = r.range, [], []
                names.append(r.block)
                held.append(Run(*(getattr(r, f) for f in Run.FIELDS)))
        if held:
            yield from decide(part, names, held)

    found = (
        exchanged.where("kind = 'runs'").select("range", "block", *Run.FIELDS)
        .repartition("range").sortWithinPartitions("range")
        .mapInPandas(decided, "block string, part int, bits binary, window array<long>, record array<long>, offset array<long>")
    )
    found = stored(found, options=LARGE_ROWS)
    late = found.where("window is not null").select("block", "part", F.explode(F.arrays_zip("window", "record", "offset")).alias("w")).select("block", "part", "w.*")
    twice = late.groupBy("window").count().where("count > 1").select("window")
    late = late.join(twice, "window").groupBy("block", "part").agg(F.collect_list(F.col("record") * width + F.col("offset")).alias("extra"))
    verdicts = found.where("window is null").select("block", "part", "bits").join(late, ["block", "part"], "left")
    verdicts = verdicts.groupBy("block").agg(F.collect_list(F.struct("part", "bits", "extra")).alias("back"))
    refs = exchanged.where("kind = 'refs'").select("block", *[F.col(f).alias(n) for f, n in zip(Run.FIELDS, ("anchor", "part", "record"))])
    back = stored(refs.join(verdicts, "block", "left"), options=LARGE_ROWS)
    released(found)
    result = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"

    def cut_out(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                lengths, data = np.frombuffer(r.b, np.int64), np.frombuffer(r.a, np.uint8)
                dup = _repeated(r, len(data), width)
                out, begin = [], 0
                for i, n in zip((x["v"] for x in r.ids), lengths.tolist()):
                    own = data[begin : begin + n]
                    starts = np.flatnonzero(dup[begin : begin + n])
                    begin += n
                    spans = []
                    if len(starts):
                        gap = np.flatnonzero(np.diff(starts) > window)
                        first = np.concatenate([starts[:1], starts[gap + 1]])
                        last = np.concatenate([starts[gap], starts[-1:]]) + window
                        keep = np.ones(n, dtype=bool)
                        for x, y in zip(first.tolist(), last.tolist()):
                            keep[x:y] = False
                            spans.append({"start": x, "end": y})
                        own = own[keep]
                    out.append((i, n, n - len(own), len(spans), hashlib.sha256(own.tobytes()).hexdigest(), spans))
                yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]).astype({"id": object})

    joined = blocks.drop("c").join(back.hint("merge"), "block", "left")
    return joined.mapInPandas(cut_out, result).withColumnRenamed("id", id_col)


def _anchors_of(c: bytes) -> tuple[np.ndarray, np.ndarray]:
    all_ = np.frombuffer(c, np.int32).astype(np.int64).reshape(4, -1)
    return all_[:3], all_[3]


def _repeated(r, n: int, width: int) -> np.ndarray:
    """Whether the window that starts at each byte of the block occurs again."""
    dup = np.zeros(n, dtype=bool)
    if r.anchor is None:
        return dup
    anchor, part, record = (np.frombuffer(x, np.int32).astype(np.int64) for x in (r.anchor, r.part, r.record))
    for x in r.back if r.back is not None else []:
        mine = np.flatnonzero(part == x["part"])
        rows = -(-width // 8)
        count = int(record[mine].max()) + 1 if len(mine) else 0
        bits = np.zeros((count, width), dtype=bool)
        if x["bits"]:
            bits |= np.unpackbits(np.frombuffer(x["bits"], np.uint8).reshape(-1, rows), axis=1, count=width).astype(bool)
        if x["extra"] is not None:
            extra = np.asarray(x["extra"], dtype=np.int64)
            bits[extra // width, extra % width] = True
        i, offset = np.nonzero(bits[record[mine]])
        dup[anchor[mine][i] - offset] = True
    return dup
