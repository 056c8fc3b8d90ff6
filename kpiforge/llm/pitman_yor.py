"""Language-model scoring with a hierarchical Pitman-Yor model.

One restaurant per previous word (by its 64-bit hash; the first word of a text follows the end token) orders
from the root, which serves words from a uniform base; the number of restaurants grows with the corpus.
Seating is sampled by Gibbs: in every sweep the tables of each dish are drawn anew, customer by customer,
by the Chinese-restaurant rule given everything else, and the predictive probabilities are averaged over
the sweeps after the first ones. The sampler is a parallel one: all dishes draw at once from the tables of the
sweep before. Its random numbers come from the hash of (previous word, word, sweep), so results do not depend on
how the work is cut up.

A task turns about ``BLOCK`` tokens into distinct (word, previous word) pairs before anything is shuffled.
All pairs of a previous word lie in one part, so that a restaurant knows its own totals; previous words of
more than ``SPREAD`` tokens are spread over several parts by the word that follows. The dishes of the root (and
the totals of spread restaurants) lie in buckets by their hash. In a sweep the parts draw their tables and send
each bucket the sums for its words; the buckets add them up, draw the root's tables and send back what the
parts need. Only a few scalars and the spread words (at most ``MAX_SPREAD``) reach the driver.

The large shuffles (of the blocks' pairs before the sweeps, of all that a part knows after them) are made in
``ROUNDS``, some of the parts in each, so that never more than a round's share lies in a shuffle beside its stored copy.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.bytescan import hashes, mixed, running, texts_of
from kpiforge.llm.common import SPACE, released, stored

MODULUS, HELD = 7, 2
BLOCK = 2_500_000
#: Text bytes of one part of the vocabulary, and the most parts.
PART_BYTES = 16 << 20
MAX_PARTS = 1 << 16
STRENGTH = 1.0
BURN_IN, SAMPLES = 1, 3
#: Customers of a dish beyond this many are seated in groups (a binomial draw each).
SINGLY = 48
SEED = 5
#: Over how many rounds the parts are dealt where all that they hold is shuffled.
ROUNDS = 4
#: Tokens after which a context is spread over several parts, and the most contexts that are.
SPREAD, MAX_SPREAD = 400_000, 1 << 20
_ODD, _STEP = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
END = np.uint64(1)
_SLICE = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACE.encode())] = True


def held_out(key: object) -> bool:
    """Whether a document is kept from training; a null id counts as an empty text."""
    return zlib.crc32(("" if key is None else str(key)).encode()) % MODULUS == HELD


def _tokens(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of lower-cased bytes."""
    a = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    h = hashes(running(a), start, end)
    h[h <= END] += np.uint64(2)
    return start, h


def _slices(texts: list[bytes]):
    """(joined bytes, lengths) of runs of texts of about _SLICE bytes."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= _SLICE:
            yield run
            run, size = [], 0
    if run:
        yield run


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0: as many bytes as the largest needs, by place, compressed before Spark moves them."""
    x = x.astype(np.uint64)
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(b: bytes) -> np.ndarray:
    width, n = b[0], int.from_bytes(b[1:9], "little")
    planes = np.frombuffer(pa.decompress(b[9:], n * width, codec="zstd"), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.int64).reshape(-1)


def _steps(x: np.ndarray) -> bytes:
    """Ascending whole numbers or hashes."""
    return _packed(np.diff(x, prepend=x.dtype.type(0)))


def _climbed(b: bytes, kind=np.int64) -> np.ndarray:
    return np.cumsum(_unpacked(b).view(kind))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse, in less memory."""
    order = np.argsort(x)
    x = x[order]
    new = np.concatenate([[True], x[1:] != x[:-1]])
    x = x[new]
    inverse = np.empty(len(order), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return x, inverse


class _Block:
    def __init__(self):
        self.hash, self.length, self.ids, self.size = [], [], [], 0

    def add(self, ids: list, texts: list[bytes]) -> None:
        """Tokens of each text: its words and the end."""
        joined = b"\n".join(texts).lower() + b"\n"
        start, h = _tokens(joined)
        stops = np.cumsum([len(t) + 1 for t in texts])
        per = np.diff(np.concatenate([[0], np.searchsorted(start, stops)]))
        self.hash.append(np.insert(h, np.cumsum(per), END))
        self.length.append(per + 1)
        self.ids += ids
        self.size += len(h) + len(texts)

    def rows(self, name: str, parts: int, spread: tuple):
        length = np.concatenate(self.length)
        words, inverse = _distinct(np.concatenate(self.hash))
        self.hash = []
        # every text ends with the end token, so the token before a text's first is the end too
        key = inverse.astype(np.int64) * len(words)
        key[1:] += inverse[:-1]
        key[0] += np.searchsorted(words, END)
        del inverse
        pairs, pair = _distinct(key)
        del key
        train = np.array([not held_out(i) for i in self.ids])
        count = np.bincount(pair[np.repeat(train, length)], minlength=len(pairs))
        word, context = words[pairs // len(words)], words[pairs % len(words)]
        del pairs
        part = _part(mixed(context + _slot(word, context, spread)), parts)
        order = np.argsort(part, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        ids = [{"v": i} for i in self.ids]
        yield ("docs", name, -1, [length.astype(np.int32).tobytes(), _packed(rank[pair]), np.packbits(~train).tobytes()], ids)
        del pair, rank
        bounds = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
        for p in np.flatnonzero(np.diff(bounds)):
            at = order[bounds[p] : bounds[p + 1]]
            own, per = np.unique(word[at], return_counts=True)
            contexts, place = _distinct(context[at])
            v = [_steps(own), _packed(per), _steps(contexts), _packed(place), _packed(count[at])]
            yield ("pairs", name, int(p), v, [])


def _among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """The places of x in a sorted array, -1 for those that are not there."""
    at = np.searchsorted(sorted_, x)
    found = at < len(sorted_)
    found[found] = sorted_[at[found]] == x[found]
    return np.where(found, at, -1)


def _slot(word: np.ndarray, context: np.ndarray, spread: tuple) -> np.ndarray:
    """Which of its context's slots a pair is in; only spread contexts have several."""
    at, out = _among(context, spread[0]), np.zeros(len(context), np.uint64)
    out[at >= 0] = mixed(word[at >= 0]) % spread[1][at[at >= 0]]
    return out


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _spread(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of over SPREAD tokens (at most MAX_SPREAD of them) and over how many slots each goes.

    This decides only where pairs are worked on. Words seen under four times in a run of texts do not count for it.
    """

    def run(batches):
        for b in batches:
            for texts in _slices(texts_of(b.column(0))):
                words, n = np.unique(_tokens(b"\n".join(texts).lower() + b"\n")[1], return_counts=True)
                words, n = words[n > 3], n[n > 3]
                words, n = np.append(words, END), np.append(n, len(texts))
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["h", "n"])

    counted = docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") > SPREAD).orderBy(F.desc("n"), "h").limit(MAX_SPREAD).collect()
    found = sorted((r["h"] % (1 << 64), r["n"] // SPREAD + 1) for r in found)
    return np.array([h for h, _ in found], np.uint64), np.array([n for _, n in found], np.uint64)


def _of_round(part, rounds: int):
    return F.pmod(part, F.lit(rounds))


def _blocks(docs: DataFrame, id_col: str, text_col: str, parts: int, rounds: int, block: int, spread: tuple) -> DataFrame:
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    kind = source.schema["id"].dataType
    schema = f"kind string, block string, part int, v array<binary>, ids array<struct<v:{kind.simpleString()}>>"

    def run(batches):
        from pyspark import TaskContext

        at, n, own = TaskContext.get().partitionId(), 0, _Block()

        def flush():
            names = ["kind", "block", "part", "v", "ids"]
            types = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.struct([("v", id_type)]))]
            for row in own.rows(f"{at}-{n}", parts, spread):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for b in batches:
            id_type = b.schema.field(0).type
            ids, done = b.column(0).to_pylist(), 0
            for run_ in _slices(texts_of(b.column(1))):
                own.add(ids[done : done + len(run_)], run_)
                done += len(run_)
                if own.size >= block:
                    yield from flush()
                    own, n = _Block(), n + 1
        if own.size:
            yield from flush()

    return stored(source.mapInArrow(run, schema).withColumn("round", _of_round(F.col("part"), rounds)), by=["kind", "round"])


class _Pairs:
    """The pairs of one part: words, and per pair its word's place and context, in order."""

    def __init__(self, words, place, context, count):
        self.words, self.place, self.context, self.count = words, place, context, count

    @classmethod
    def read(cls, v):
        words, contexts = _climbed(v[0], np.uint64), _climbed(v[2], np.uint64)
        return cls(words, np.repeat(np.arange(len(words)), _unpacked(v[1])), contexts[_unpacked(v[3])], _unpacked(v[4]))

    @classmethod
    def merged(cls, all_: list):
        """The training counts of several, summed; ``at``: where the pairs of each went, one after the other."""
        words = np.unique(np.concatenate([p.words for p in all_]))
        contexts = np.unique(np.concatenate([p.context for p in all_]))
        key = np.concatenate([np.searchsorted(words, p.words)[p.place] for p in all_]) * len(contexts)
        key += np.concatenate([np.searchsorted(contexts, p.context) for p in all_])
        keys, at = _distinct(key)
        count = np.bincount(at, weights=np.concatenate([p.count for p in all_]), minlength=len(keys)).astype(np.int64)
        out = cls(words, keys // len(contexts), contexts[keys % len(contexts)], count)
        out.at = at
        return out


def _times(i: int, odd: int) -> np.uint64:
    return np.uint64(i * odd % (1 << 64))


def _key(word: np.ndarray, context: np.ndarray, sweep: int) -> np.ndarray:
    """Where the random numbers of a dish in a sweep start: they do not depend on how the work is cut up."""
    return mixed((word ^ mixed(context + np.uint64(SEED))) + _times(sweep, _ODD))


def _uniform(key: np.ndarray, i: int) -> np.ndarray:
    return (mixed(key + _times(i, _STEP)) >> np.uint64(11)) * 2.0**-53


def _binomial(m: np.ndarray, p: np.ndarray, key: np.ndarray, i: int) -> np.ndarray:
    """Successes in m trials, by inversion; rounded normal draws where over 30 are expected."""
    u, k, mean = _uniform(key, i), np.zeros(len(m)), m * p
    few = np.flatnonzero(mean <= 30)
    chance = np.exp(m[few] * np.log1p(-p[few]))
    sum_, n = chance.copy(), 0
    while len(on := np.flatnonzero((u[few] > sum_) & (n < m[few]))):
        few, chance, sum_ = few[on], chance[on], sum_[on]
        chance *= (m[few] - n) / (n + 1) * p[few] / (1 - p[few])
        sum_ += chance
        n += 1
        k[few] = n
    many = mean > 30
    normal = np.sqrt(-2 * np.log(1 - u[many])) * np.cos(2 * np.pi * _uniform(key[many], ~i & 0xFFFFFFFF))
    k[many] = np.clip(np.rint(mean[many] + np.sqrt(mean[many] * (1 - p[many])) * normal), 0, m[many])
    return k


def _seated(c: np.ndarray, a: np.ndarray, d: float, key: np.ndarray) -> np.ndarray:
    """Tables of c customers of a dish: the next opens a table with odds a : (customers - d tables)."""
    out = np.minimum(c, 1).astype(float)
    order = np.flatnonzero(c > 1)
    order = order[np.argsort(-c[order], kind="stable")]
    c, a, key = c[order], a[order], key[order]
    less, t = -c, np.ones(len(c))
    for i in range(1, SINGLY):
        n = int(np.searchsorted(less, -i, "left"))  # those with more than i customers
        if not n:
            break
        t[:n] += _uniform(key[:n], i) * (a[:n] + i - d * t[:n]) < a[:n]
    i = SINGLY
    while (n := int(np.searchsorted(less, -i, "left"))) > 0:
        step = max(8, i // 8)
        m = np.minimum(c[:n] - i, step)
        t[:n] += _binomial(m, a[:n] / (a[:n] + i + m / 2 - d * t[:n]), key[:n], i)
        i += step
    out[order] = np.minimum(t, c)
    return out


def _root(c0, t0, facts: dict):
    """The root's predictive probabilities of words with c0 customers and t0 tables there."""
    d = facts["d"][0]
    return (c0 - d * t0 + (STRENGTH + d * facts["T0"]) / (facts["V"] + 1)) / (STRENGTH + facts["C0"])


def _orders(tables, root, facts: dict):
    """What restaurants with so many tables pass to the root for words of these probabilities."""
    return (STRENGTH + facts["d"][-1] * tables) * root


def _served(c, t, tables, customers, root, facts: dict):
    """Predictive probabilities in restaurants with so many tables and customers, c and t of them the word's."""
    return (c - facts["d"][-1] * t + _orders(tables, root, facts)) / (STRENGTH + customers)


def _root_tables(c0, facts: dict, key):
    d = facts["d"][0]
    return _seated(c0, np.full(len(c0), (STRENGTH + d * facts["T0"]) / (facts["V"] + 1)), d, key)


def _messages(own, t: np.ndarray, buckets: int, first: bool):
    """Per bucket: its keys' tables in this part as dish and as spread restaurant; at first their customers and the keys too."""
    keys, word, context, count, _, far = own
    there = far >= 0
    sums = []
    for w in (t, count) if first else (t,):
        sums.append(np.bincount(word, weights=w, minlength=len(keys)))
        per = np.bincount(context, weights=w, minlength=len(far))[there]
        sums.append(np.bincount(far[there], weights=per, minlength=len(keys)))
    bounds = np.concatenate([[0], np.cumsum(np.bincount(_part(keys, buckets), minlength=buckets))])
    for b in np.flatnonzero(np.diff(bounds)):
        x, y = bounds[b], bounds[b + 1]
        yield int(b), [*[_packed(s[x:y]) for s in sums], *([_steps(keys[x:y])] if first else [])]


def _own(v) -> tuple:
    """keys, per pair the places of its word (in keys) and context, its count; the contexts, their places in keys or -1."""
    ints = _climbed(v[1]), _unpacked(v[2]), _unpacked(v[3])
    return _climbed(v[0], np.uint64), *ints, _climbed(v[4], np.uint64), _unpacked(v[5]) - 1


def _restaurants(own, weights, told: np.ndarray) -> np.ndarray:
    """Per context the sum of its pairs' weights; ``told``: the sums over all parts, for the spread ones."""
    far = own[5]
    out = np.bincount(own[2], weights=weights, minlength=len(far))
    out[far >= 0] = told[far[far >= 0]]
    return out


def _added(rows: pd.DataFrame, facts: dict, sweep: int):
    """One bucket's answers to the parts that sent ``rows``, its share of the scalars and, at first, its book.

    The book, in the row of part -1, is what stays the same: the keys, their customers, and which of them
    each part asks for.
    """
    book, sent = rows[rows["part"] < 0], rows[rows["part"] >= 0]
    got = [[_unpacked(v[i]) for v in sent["v"]] for i in (0, 1)]
    stops = np.cumsum([0] + [len(x) for x in got[0]])
    if not len(book):
        keys, at = _distinct(np.concatenate([_climbed(v[4], np.uint64) for v in sent["v"]]))
        n, customers = (np.bincount(at, weights=np.concatenate([_unpacked(v[i]) for v in sent["v"]])) for i in (2, 3))
        steps = np.diff(at, prepend=0)
        steps[stops[:-1]] = at[stops[:-1]]
        yield -1, "book", [_steps(keys), _packed(n), _packed(customers), _packed(steps)], []
    else:
        v = book["v"].iloc[0]
        keys, n, customers, steps = _climbed(v[0], np.uint64), *[_unpacked(x) for x in v[1:]]
        at = np.concatenate([np.cumsum(steps[x:y]) for x, y in zip(stops, stops[1:])])
    c0, tables = (np.bincount(at, weights=np.concatenate(x), minlength=len(keys)) for x in got)
    t0 = _root_tables(c0, facts, _key(keys, keys, sweep)) if len(book) else np.minimum(c0, 1)
    for part, x, y in zip(sent["part"], stops, stops[1:]):
        yield int(part), "answer", [_packed(z[at[x:y]]) for z in (c0, t0, tables, n, customers)], []
    yield -1, "facts", [], [float(x) for x in (t0.sum(), c0.sum(), (n > 0).sum(), n.sum(), (c0 == 1).sum(), (c0 == 2).sum())]


def score(
    docs: DataFrame, id_col="doc_id", text_col="text", block: int = BLOCK, part_bytes: int = PART_BYTES,
    burn_in: int = BURN_IN, samples: int = SAMPLES, seed: int = SEED,
) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    The model learns from the rows that are not held out and scores all. Null and empty texts are the
    end token alone, null ids count as an empty id, repeated rows are read and scored each. An empty
    table gives no rows; without any training row every token is unknown. Words are told apart
    by 64-bit hashes.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(1, min(MAX_PARTS, -(-size // part_bytes)))
    rounds = min(ROUNDS, parts)
    spread = _spread(docs, text_col)
    tables = _blocks(docs, id_col, text_col, parts, rounds, block, spread)
    work = "kind string, part int, bucket int, tag string, v array<binary>, ones long, twos long"

    def messages(part: int, own: tuple, t: np.ndarray, first: bool = False) -> list:
        return [("message", part, b, "", v, 0, 0) for b, v in _messages(own, t, parts, first)]

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        all_ = [_Pairs.read(v) for v in rows["v"]]
        p = _Pairs.merged(all_)
        contexts = np.unique(p.context)
        there = _among(contexts, spread[0]) >= 0
        keys = np.union1d(p.words, contexts[there])
        far = np.where(there, np.searchsorted(keys, contexts), -1)
        word, context = np.searchsorted(keys, p.words)[p.place], np.searchsorted(contexts, p.context)
        v = [_steps(word), _packed(context), _packed(p.count), _steps(contexts), _packed(far + 1)]
        v = [_steps(keys), *v]
        out, done = [("own", key[0], 0, "own", v, int((p.count == 1).sum()), int((p.count == 2).sum()))], 0
        for name, q in zip(rows["block"], all_):
            out.append(("place", key[0], 0, "p" + name, [_steps(p.at[done : done + len(q.count)])], 0, 0))
            done += len(q.count)
        return pd.DataFrame(out + messages(key[0], _own(v), np.minimum(p.count, 1), True), columns=work_names)

    work_names = [c.split()[0] for c in work.split(", ")]

    def by(df: DataFrame, key: str):
        # a given number of partitions is not merged, so that a task holds few parts
        return df.repartition(parts, key).groupBy(key)

    def union(all_: list) -> DataFrame:
        return reduce(DataFrame.unionByName, all_)

    def of_kind(df: DataFrame, kind: str) -> DataFrame:
        return df.where(F.col("kind") == kind).select("part", "tag", "v")

    merging = []
    for r in range(rounds):
        pairs = tables.where((F.col("kind") == "pairs") & (F.col("round") == r)).select("block", "part", "v")
        merging.append(stored(by(pairs, "part").applyInPandas(merge, work), by="kind"))
        released(pairs, only=f"/kind=pairs/round={r}/")
    merged = union(merging)
    own = of_kind(merged, "own")
    ones, twos = (x or 0 for x in merged.agg(F.sum("ones"), F.sum("twos")).first())

    def discount(one: float, two: float) -> float:
        return float(np.clip(one / max(one + 2 * two, 1), 0.05, 0.95))

    answer = "kind string, bucket int, part int, tag string, v array<binary>, x array<double>"

    def exchanged(worked: DataFrame, sweep: int, facts: dict, books: DataFrame | None):
        """The buckets' answers to the parts' messages, the facts after them and the books."""

        def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            answers = _added(rows.sort_values("part"), facts, sweep + seed)
            out = [(kind, key[0], p, f"{key[0]:08d}", v, x) for p, kind, v, x in answers]
            return pd.DataFrame(out, columns=["kind", "bucket", "part", "tag", "v", "x"])

        sent = worked.where("kind = 'message'").select("bucket", "part", "v")
        rows = sent if books is None else sent.unionByName(books)
        back = stored(by(rows, "bucket").applyInPandas(add, answer), by="kind")
        released(sent, only="/kind=message/")
        sums = back.where("kind = 'facts'").agg(*[F.sum(F.col("x")[i]) for i in range(6)]).first()
        t0, c0, v, n, one, two = (x or 0.0 for x in sums)
        d = facts.get("d") or [discount(one, two), discount(ones, twos)]
        if books is None:
            books = back.where("kind = 'book'").select("bucket", "part", "v")
        return of_kind(back, "answer"), {"d": d, "V": int(v), "N": int(n), "T0": t0, "C0": c0}, books

    def told(rows: pd.DataFrame, facts: dict, take: bool):
        """What a part has of its pairs and the answers to its last message; ``take``: this sweep counts."""
        got = dict(zip(rows["tag"], rows["v"]))
        own = keys, word, context, count, contexts, far = _own(got["own"])
        answers = [got[tag] for tag in sorted(t for t in got if t[0].isdigit())]
        c0, t0, at, n, customers = (np.concatenate([_unpacked(a[i]) for a in answers]) for i in range(5))
        root = _root(c0, t0, facts)[word]
        state = got.get("state")
        t = np.minimum(count, 1) if state is None else _unpacked(state[0])
        total = np.frombuffer(state[1], np.float32) if state is not None and state[1] else np.zeros(len(count), np.float32)
        tables = _restaurants(own, t, at)[context]
        if take:
            total = total + _served(count, t, tables, _restaurants(own, count, customers)[context], root, facts).astype(np.float32)
        return got, own, _orders(tables, root, facts), total, n[word]

    def drawn(sweep: int, facts: dict):
        take = sweep > burn_in

        def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            _, own, odds, total, _ = told(rows, facts, take)
            keys, word, context, count, contexts, _ = own
            t = _seated(count, odds, facts["d"][1], _key(keys[word], contexts[context], sweep + seed))
            state = ("state", key[0], 0, "state", [_packed(t), total.tobytes() if take else b""], 0, 0)
            return pd.DataFrame([state, *messages(key[0], own, t)], columns=work_names)

        return draw

    answers, facts, books = exchanged(merged, 0, {}, None)
    state = None
    for s in range(burn_in + samples):
        rows = union([own, answers] if state is None else [own, answers, state])
        worked = stored(by(rows, "part").applyInPandas(drawn(s, facts), work), by="kind")
        released(answers, only="/kind=answer/")
        if state is not None:
            released(state, only="/kind=state/")
        state = of_kind(worked, "state")
        answers, facts, books = exchanged(worked, s + 1, facts, books)

    def predicted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        got, _, _, total, n = told(rows, facts, True)
        p, out = np.log10(total / samples).astype(np.float32), []
        for tag, v in got.items():
            if tag[0] == "p":
                at = _climbed(v[0])
                out.append((tag[1:], key[0], p[at].tobytes(), _packed(n[at])))
        return pd.DataFrame(out, columns=["of", "part", "p", "n"])

    released(books, only="/kind=book/")
    told_last, predictions = union([answers, state]), []
    for r in range(rounds):
        rows = [of_kind(merging[r], "own"), of_kind(merging[r], "place"), told_last.where(_of_round(F.col("part"), rounds) == r)]
        found = by(union(rows), "part").applyInPandas(predicted, "of string, part int, p binary, n binary")
        predictions.append(stored(found))
        released(merging[r])
    released(answers, only="/kind=answer/")
    released(state, only="/kind=state/")
    kind = docs.schema[id_col].dataType.simpleString()
    result = (
        f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    texts = tables.where("kind = 'docs'").select("block", "v", "ids")
    n_all, v_all = facts["N"], facts["V"]

    def total(key: tuple, own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        row, got = own.iloc[0], got.sort_values("part")
        length, pair = np.frombuffer(row["v"][0], np.int32), _unpacked(row["v"][1])
        held = np.unpackbits(np.frombuffer(row["v"][2], np.uint8), count=len(length)).astype(bool)
        logp = np.concatenate([np.frombuffer(x, np.float32) for x in got["p"]]).astype(np.float64)
        c = np.concatenate([_unpacked(x) for x in got["n"]])
        base = np.log10((c + 1) / (n_all + 1 * (v_all + 1)))
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        ids = [x["v"] for x in row["ids"]]
        return pd.DataFrame({
            "id": pd.Series(ids, dtype=object), "held_out": held, "n_tokens": length.astype(np.int64),
            "n_known": np.add.reduceat((c > 0).astype(np.int64)[pair], first), "train_tokens": np.int64(n_all),
            "base_score": np.add.reduceat(base[pair], first), "score": np.add.reduceat(logp[pair], first),
        })

    scored = stored(texts.groupBy("block").cogroup(union(predictions).groupBy("of")).applyInPandas(total, result))
    released(texts, *predictions)
    return scored.withColumnRenamed("id", id_col)
