"""SimHash near-dedup over a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most d bits differ in at most d of their 8 bytes, so they
share at least 8 - d bytes at equal positions. The positions are dealt into d + 2 groups (8 at most), of which
a pair within d bits has at least two in common: a list of the index holds the fingerprints with given
bytes at the positions of two groups (for d = 2: four of the eight bytes, six lists a fingerprint). Pairs
of a list are tallied: the shared positional bytes are counted, pairs with fewer than the 8 - d that
are guaranteed are dropped, the others are verified bit by bit. A list of more than ``DENSE`` members is divided by
further positions until it is small or holds all 8 - d bytes; lists of more than ``HOT`` members are divided by
Spark first. A list emits at most one link per member (a spanning forest), and links are joined to components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import BROADCAST_ROWS, attach, cut, fresh

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Lists up to this size are compared pair by pair; lists up to HOT members are held by one task.
DENSE, HOT = 256, 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: per bit the majority of the shingles' XXH64; 0 without words."""
    import xxhash

    ws = text.lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    lengths = np.fromiter(map(len, ws), dtype=np.int64, count=len(ws))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(shingle, len(ws))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(ws) - k + 1].tolist(), ends[k - 1 :].tolist())
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], text_col="text", shingle: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` and fp, the fingerprint as a signed long; null texts count as empty."""
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("binary").alias("__text"))
    schema = source.drop("__text").schema.add("fp", "long")

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1)
            fps = [fingerprint((t.as_buffer().to_pybytes() if t.is_valid else b""), shingle) for t in texts]
            fps = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fps], names=[*keep, "fp"])

    return source.mapInArrow(run, schema)


def groups_of(max_bits: int) -> list[tuple[int, ...]]:
    """The 8 positions in max_bits + 2 groups, 8 at most."""
    return [tuple(g.tolist()) for g in np.array_split(np.arange(8), min(8, max_bits + 2))]


def tally(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Positional bytes that pairs of fingerprints share."""
    return 8 - np.count_nonzero((left ^ right).view(np.uint8).reshape(-1, 8), axis=1)


class _Forest:
    """A spanning forest of the links between one list's members."""

    def __init__(self, members: np.ndarray, max_bits: int):
        self.members, self.max_bits = np.unique(members), max_bits
        self.root = np.arange(len(self.members))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist()):
            a, b = self.find(a), self.find(b)
            if a != b:
                self.root[max(a, b)] = min(a, b)

    def grow(self, at: np.ndarray, fixed: tuple[int, ...]) -> None:
        """Link the members at ``at``, which share the bytes at the positions ``fixed``."""
        need = 8 - self.max_bits
        if len(at) <= DENSE:
            left, right = np.triu_indices(len(at), 1)
            left, right = at[left], at[right]
            kept = tally(self.members[left], self.members[right]) >= need
            left, right = left[kept], right[kept]
            met = np.bitwise_count(self.members[left] ^ self.members[right]) <= self.max_bits
            self.join(left[met], right[met])
        elif len(fixed) >= need:  # the whole tally is shared; each member's neighbours are looked up
            own = self.members[at]
            free = [8 * p + i for p in range(8) if p not in fixed for i in range(8)]
            for count in range(1, self.max_bits + 1):
                for bits in combinations(free, count):
                    other = own ^ np.uint64(sum(1 << b for b in bits))
                    place = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    met = (own[place] == other) & (other > own)
                    self.join(at[met], at[place[met]])
        else:  # a pair shares need - len(fixed) of the other positions: one list for each choice of them
            rest = [p for p in range(8) if p not in fixed]
            for more in combinations(rest, need - len(fixed)):
                shared = self.members[at] & np.uint64(sum(0xFF << (8 * p) for p in more))
                order = np.argsort(shared, kind="stable")
                cuts = np.flatnonzero(np.diff(shared[order])) + 1
                for part in np.split(at[order], cuts):
                    if len(part) > 1:
                        self.grow(part, (*fixed, *more))

    def links(self) -> list[tuple[int, int]]:
        roots = [self.find(i) for i in range(len(self.members))]
        return [(int(self.members[i]), int(self.members[r])) for i, r in enumerate(roots) if i != r]


def _forest(list_: np.ndarray, positions: tuple[int, ...], max_bits: int) -> list[tuple[int, int]]:
    """Links (member, root) that join the members of one list of the index that are within max_bits."""
    forest = _Forest(list_, max_bits)
    forest.grow(np.arange(len(forest.members)), positions)
    return forest.links()


def _entries(choices: list[tuple[int, ...]], start: int):
    """Index entries of a fingerprint: number of the choice of positions and the bytes there."""
    out = []
    for i, c in enumerate(choices):
        mask = sum(0xFF << (8 * p) for p in c)
        mask = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(start + i).cast("short").alias("positions"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("shared")))
    return F.array(*out)


def links(fps: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT, n: int | None = None) -> DataFrame:
    """(u, v): links between the ``n`` (None: not counted) different fingerprints of ``fps`` (column fp, distinct).

    Fingerprints within ``max_bits`` of each other are joined by a path of links.
    """
    if not 0 < max_bits < 8:
        raise ValueError("max_bits must be 1 to 7")
    groups = groups_of(max_bits)
    choices = [tuple(sorted(sum(c, ()))) for c in combinations(groups, len(groups) - max_bits)]
    whole = list(combinations(range(8), 8 - max_bits))
    spread = fps.repartition(max(fps.sparkSession.sparkContext.defaultParallelism, 8))  # a small table of heavy rows
    entries = spread.select("fp", F.explode(_entries(choices, 0)).alias("entry"))
    crowded = None
    if n is None or n > hot:  # no list has more members than there are fingerprints
        crowded = cut(entries.groupBy("entry").count().where(F.col("count") > hot).select("entry"))
    if crowded is not None and not crowded.isEmpty():
        full = entries.join(crowded, "entry", "left_semi").select("fp").distinct()
        finer = full.select("fp", F.explode(_entries(whole, len(choices))).alias("entry"))
        entries = entries.join(crowded, "entry", "left_anti").select("fp", "entry").unionByName(finer)
    lists = (
        entries.groupBy("entry")
        .agg(F.collect_list("fp").alias("members"))
        .where(F.size("members") > 1)
        .select("entry.positions", "members")
    )
    by_number = [*choices, *whole]

    def run(batches):
        for b in batches:
            out = []
            for p, m in zip(b.column(0).to_pylist(), b.column(1)):
                out += _forest(m.values.to_numpy().view(np.uint64), by_number[p], max_bits)
            u, v = np.array([x[0] for x in out], np.uint64), np.array([x[1] for x in out], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return lists.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node reachable.

    Alternating star contraction: each round every node's larger, then smaller neighbours are linked
    to its smallest neighbour; it ends when a round changes nothing. Rounds are written to the
    shared folder.
    """
    star = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = star.union(star.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(low, both["u"] == low["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        joined = large.join(low, large["u"] == low["n"])
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = cut(small.union(low.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct())
        now = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _grouped(rows: DataFrame, id_col: str, max_bits: int) -> DataFrame:
    """``rows`` (with fp, cut) and ``group`` (a fingerprint of the component), ``least`` (smallest id)."""
    own = cut(rows.groupBy("fp").agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("n")))
    n = own.count()
    tree = cut(components(links(own.select("fp"), max_bits, n=n)))
    inside = tree.join(own, tree["node"] == own["fp"]).select("node", "root", "first")
    least = inside.groupBy("root").agg(F.min("first").alias("least"))
    joined = inside.join(least, "root").select(F.col("node").alias("fp"), F.col("root").alias("group"), "least")
    several = own.where("n > 1").join(joined.select("fp"), "fp", "left_anti")
    groups = joined.union(several.select("fp", F.col("fp").alias("group"), F.col("first").alias("least")))
    # one fingerprint may be that of a third of all rows: few groups are broadcast, many joined with salts
    found = rows.join(F.broadcast(groups), "fp", "left") if n <= BROADCAST_ROWS else attach(rows, cut(groups), ["fp"])
    least = F.when(F.col("group").isNull(), F.col(f"`{id_col}`")).otherwise(F.col("least"))
    return found.withColumns({"least": least, "group": F.coalesce("group", "fp")})


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle=SHINGLE, max_bits=MAX_BITS) -> DataFrame:
    """(id, fingerprint, component_id) for every row.

    ``fingerprint`` is 16 lowercase hex digits. ``component_id`` is the smallest id among the rows
    whose fingerprints are joined by steps of at most ``max_bits`` differing bits, equal ones
    included; it is null where no row of the component has an id. Texts without words share
    fingerprint 0. Repeated rows give repeated results, an empty table none.
    """
    rows = cut(fingerprints(docs, [id_col], text_col, shingle))
    return _grouped(rows, id_col, max_bits).select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id")
    )


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", shingle=SHINGLE, max_bits=MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one with the smallest id, nulls last.

    Rows of equal id are told apart by a hash of the whole row; rows that are equal throughout
    collapse. Columns stay as they are.
    """
    row = fresh(docs, "__row")
    tagged = docs.withColumn(row, F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))
    rows = _grouped(cut(fingerprints(tagged, [id_col, row], text_col, shingle)), id_col, max_bits)
    order = F.struct(F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`").alias("i"), F.col(row).alias("r"))
    best = rows.groupBy("group").agg(F.min(order).alias("k")).select(F.col("k.i").alias("__i"), F.col("k.r").alias("__r"))
    match = (tagged[row] == F.col("__r")) & tagged[id_col].eqNullSafe(F.col("__i"))
    return tagged.join(best, match, "left_semi").dropDuplicates([id_col, row]).select(*docs.columns)
