"""Operators on texts against brute force, with nulls, empty and repeated rows, ties and empty tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from kpiforge.llm import line_dedup, mixing, packing, pitman_yor, quality, sharding, simhash, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, source string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = say(60)
    out = []
    for i in range(60):
        text = ". ".join(say(rng.randint(1, 30)) for _ in range(rng.randint(1, 5)))
        if i % 7 == 0:
            text = f"{text}\n{passage} {say(5)}\nRead more here"
        out.append((i, text, None if i % 11 == 0 else f"s{i % 4}"))
    out += [(100 + i, out[3][1], "s1") for i in range(4)]
    out += [(200, None, "s0"), (201, "", "s1"), (202, " \n\t ", None), (203, "x" * 700, "s2"), (204, "ÄÖ Straße ſ " * 40, "s2")]
    out += [(205, say(4000), "s3"), (None, say(40), "s3"), (None, None, None), (7, out[7][1], out[7][2])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def bag(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_suffix_dedup(docs, rows, empty):
    texts = [(i, (t or "").encode()) for i, t, _ in rows]
    for window, how in ((200, {}), (30, {"block": 2000, "range_bytes": 3000}), (30, {"block": 2000, "group_max": 3})):
        seen = Counter(t[i : i + window] for _, t in texts for i in range(len(t) - window + 1))
        want = Counter()
        for key, t in texts:
            keep = np.ones(len(t), dtype=bool)
            for i in range(len(t) - window + 1):
                if seen[t[i : i + window]] > 1:
                    keep[i : i + window] = False
            spans = int((np.diff(np.concatenate([[1], keep.astype(int), [1]])) == -1).sum())
            left = np.frombuffer(t, np.uint8)[keep].tobytes()
            want[(key, len(t), len(t) - len(left), spans, hashlib.sha256(left).hexdigest())] += 1
        got = suffix_dedup.dedup(docs, window=window, **how)
        assert bag(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix_dedup.dedup(empty).count() == 0


def test_loser_tree_gives_order_and_prefixes():
    rng = random.Random(1)
    runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(rng.randint(0, 40))) for _ in range(7)]
    coded = [suffix_dedup.Run.of([(s, b"", False) for s in r]) for r in runs]
    merged = list(suffix_dedup.merge([c.suffixes() for c in coded]))
    assert [s for _, s, _ in merged] == sorted(s for r in runs for s in r)
    for (_, a, _), (n, b, _) in zip(merged, merged[1:]):
        assert n == suffix_dedup.shared(a, b, 0)


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    for window, part in ((64, 500), (4096, 1 << 22)):
        got = packing.pack(docs, TOKENIZER, window=window, partition_tokens=part).collect()
        want = Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, _ in rows)
        by_doc = defaultdict(list)
        for r in got:
            ids = np.frombuffer(r["ids"], "<u4").tolist()
            assert len(ids) == r["length"]
            by_doc[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
        for key, pieces in by_doc.items():  # repeated rows have the same pieces' ids; null ids are several texts
            total = Counter(x for _, ids, _ in pieces for x in ids)
            assert total == sum((Counter(ids) for (i, ids), n in want.items() if i == key for _ in range(n)), Counter())
            if key is not None and sum(n for (i, _), n in want.items() if i == key) == 1:
                joined = [x for _, ids, _ in sorted(pieces) for x in ids]
                assert ((key, tuple(joined))) in want
                assert [s for s, _, _ in sorted(pieces)] == np.cumsum([0] + [len(x) for _, x, _ in sorted(pieces)])[:-1].tolist()
        seqs = defaultdict(list)
        for r in got:
            seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        sizes = []
        for _, cells in sorted(seqs.items()):
            at = 0
            for o, n in sorted(cells):
                assert o == at
                at += n
            sizes.append(at)
        assert max(sizes) <= window and all(n == window or n & (n - 1) == 0 for n in sizes)
        assert sorted(seqs) == list(range(len(seqs)))
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_packing_keeps_proportions_in_windows(spark):
    docs = spark.createDataFrame([(i, "word " * (30 + i % 50), "a" if i % 4 else "b") for i in range(800)], SCHEMA)
    source = {i: ("a" if i % 4 else "b") for i in range(800)}
    share, whole = Counter(), Counter()
    for r in packing.pack(docs, TOKENIZER, window=512, partition_tokens=8000).collect():
        share[(r["sequence_id"], source[r["doc_id"]])] += r["length"]
        whole[source[r["doc_id"]]] += r["length"]
    b = whole["b"] / sum(whole.values())
    full = [s for s, _ in share if sum(share[(s, x)] for x in "ab") == 512]
    assert all(abs(share[(s, "b")] - b * 512) <= 2 * packing.LEAST_GRANT for s in full)
    assert abs(sum(share[(s, "b")] for s in set(full)) / (512 * len(set(full))) - b) < 0.01


def test_word_ids_equal_whole_texts():
    from tokenizers import Tokenizer

    tok, memo = Tokenizer.from_file(TOKENIZER), packing.WordIds(TOKENIZER, "<u4")
    texts = ["It's A.B., don't; X1.2,3... ÉCOLE é ﬁ İ", "a\x1cb c   d\x85e", "<|endoftext|>. <|ENDOFTEXT|> <|startoftext|>,", ".,., 9,", "STRASSE ẞ Σας"]
    for t in texts:
        ids = np.frombuffer(b"".join(memo[w] for w in t.encode().split()), "<u4").tolist()
        assert ids == tok.encode(t, add_special_tokens=False).ids


def test_text_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    rng = random.Random(3)
    marks = "abzABZéÉßÿÞøØ×÷µªºÅKİıſ'.,!*#<|>[]^_`{~09é̂中ش  \u0085’— \t\n"
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += [rng.choice(["<|endoftext|>", "<|STARTOFTEXT|>x", "it's don'T we'LL.,"]) + t for t in texts[:300]] + ["É" * 500 + "..."]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        tok, ids = Tokenizer.from_file(path), packing.TextIds(path, "<u4")
        assert (ids.words is not None) == name.startswith("word")
        for t in texts:
            assert np.frombuffer(ids(t.encode()), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_simhash(docs, rows, empty, spark):
    def fp(text):
        ws = words((text or "").encode().lower().decode())
        if not ws:
            return 0
        hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 3]), 42) for i in range(max(1, len(ws) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fp(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (key, _, _) in enumerate(rows):
        r = find(i)
        least[r] = key if least.get(r) is None else least[r] if key is None else min(key, least[r])
    want = Counter((k, f"{fps[i]:016x}", least[find(i)]) for i, (k, _, _) in enumerate(rows))
    assert bag(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len({find(i) for i in range(len(rows))})
    assert simhash.near_duplicates(empty).count() == 0
    clash = docs.withColumnRenamed("source", "fp")
    assert simhash.keep_one(clash).columns == ["doc_id", "text", "fp"]


@pytest.mark.parametrize("dense", [256, 1])
def test_simhash_links_join_all_close_fingerprints(spark, monkeypatch, dense):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(6):
            f ^= 1 << rng.randrange(64)
            f ^= (1 << rng.randrange(64)) * rng.randrange(2)
            fps.add(f)
    fps = sorted(fps)
    arr = np.array(fps, dtype=np.uint64)
    monkeypatch.setattr(simhash, "DENSE", dense)
    edges = set()
    from itertools import combinations

    for c in combinations(range(8), 6):
        mask = np.uint64(sum(0xFF << 8 * p for p in c))
        for key in np.unique(arr & mask):
            edges |= set(simhash._forest(arr[arr & mask == key], c, 2))

    def parts(pairs):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(f for f in fps if find(f) == r) for r in {find(f) for f in fps}}

    close = [(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 2]
    assert parts(edges) == parts(close)
    table = spark.createDataFrame([(int(a) % 997, int(b) % 997) for a, b in close], "u long, v long")
    found = {(r["node"], r["root"]) for r in simhash.components(table).collect()}
    assert len({n for n, _ in found}) == len(found)


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).select("doc_id", "source", "mix.*").collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    level, full = 0, set()
    while True:
        rest = [s for s in order if s not in full]
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in full)) / sum(weight[s] for s in rest)
        over = {s for s in rest if level * weight[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    for r in got:
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(min(level * weight[r["source"]], 2 * size[r["source"]]))
        rate = r["target"] / r["source_size"]
        u = int(hashlib.md5(f"{'null' if r['doc_id'] is None else r['doc_id']}:mix".encode()).hexdigest()[:13], 16) / 2**52
        assert r["copies"] == int(rate) + (u < rate - int(rate)) <= 2
    assert len(got) == len(rows)
    emitted = mixing.emit(docs.withColumn("mix", F.lit(1)).withColumn("copies", F.lit(2)))
    assert emitted.columns == ["doc_id", "text", "source", "mix", "copies"]
    assert emitted.count() == sum(r["copies"] for r in got)
    assert mixing.mix(empty).count() == 0


def test_sharding(docs, rows, empty):
    for how in ({}, {"range_rows": 2, "first_ranges": 8}, {"law": "rows", "range_rows": 3}):
        got = sharding.shard(docs, **how).collect()
        want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
        by = defaultdict(list)
        for r in got:
            by[r["shard"]].append(r)
        for part in by.values():
            assert sorted(r["slot"] for r in part) == list(range(len(part)))
        if how.get("law") == "rows":
            assert max(map(len, by.values())) - min(len(by.get(s, [])) for s in range(8)) <= 1
        else:
            most = max(r["size"] for r in got)
            total = sum(r["size"] for r in got)
            assert all(abs(sum(r["size"] for r in by[s]) - total / 8) <= most for s in by)
    assert sharding.shard(empty).count() == 0


def test_line_dedup(docs, rows, empty):
    got = line_dedup.drop_boilerplate(docs.withColumn("lines", F.lit(0)), ratio=0.2, min_pages=2)
    assert got.columns[:4] == ["doc_id", "text", "source", "lines"]
    pages, seen = Counter(s for _, _, s in rows), Counter()
    for _, t, s in rows:
        seen.update((s, x) for x in set((t or "").split("\n")) if x.strip(" \t\x0b\x0c\r"))
    want = Counter()
    for i, t, s in rows:
        if t is None:
            want[(i, None, 0, 0)] += 1
            continue
        lines = t.split("\n")
        kept = [x for x in lines if not (seen[(s, x)] >= 2 and seen[(s, x)] > 0.2 * pages[s])]
        want[(i, "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    c = got.columns[-1]
    assert bag(got.select("doc_id", "text", f"{c}.n_lines", f"{c}.n_dropped"), "doc_id", "text", "n_lines", "n_dropped") == want
    assert any(k[3] for k in want)
    assert line_dedup.drop_boilerplate(empty).count() == 0


def test_quality_counts(docs, spark, rows, empty):
    more = [(300, "a b c d e f g h i a b c d e f g h i", "s"), (301, "x " * 50, "s"), (302, "Home | About | Contact\n" * 3 + "Privacy policy", "s")]
    long = " ".join(f"word{i}" for i in range(40))
    more += [(303, f"{long} end.\nHome | About | News.\nAll rights reserved.", "s"), (304, f"{long}\n{long} x", "s"), (305, f"{long}.\n{long}.", "s")]
    frame = docs.union(spark.createDataFrame(more, SCHEMA)).withColumn("quality", F.lit(1))
    got = quality.judge(frame)
    last = got.columns[-1]
    assert last != "quality"
    for r in got.select("doc_id", "text", f"{last}.*").collect():
        t = r["text"] or ""
        ws = words(t)
        spots = defaultdict(list)
        for i in range(len(ws) - 7):
            spots[tuple(ws[i : i + 8])].append(i)
        covered = {j for x in spots.values() if len(x) > 1 for i in x for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"]) == (len(ws), sum(len(w.decode()) for w in ws))
        assert r["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>")
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == len(covered), r["doc_id"]
        assert r["base_failed"] == (len(ws) < 20 or 100 * len(covered) > 30 * len(ws))
    kept = {r["doc_id"]: (r["kept"], r["clean_text"]) for r in got.select("doc_id", f"{last}.*").collect()}
    assert kept[303] == (True, f"{long} end.") and not kept[302][0] and not kept[304][0] and not kept[305][0]
    assert quality.judge(empty).count() == 0


def test_suffix_dedup_spreads_a_frequent_passage(spark):
    """A passage in many texts with different surroundings does not fill one range; all its copies go."""
    import glob

    from kpiforge.session import checkpoint_dir

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    passage = " ".join(word() for _ in range(60))
    around = lambda: " ".join(word() for _ in range(30))
    rows = [(i, f"{around()} {passage} {around()}", "s") for i in range(200)]
    folder = f"{checkpoint_dir(spark).removeprefix('file://').rstrip('/')}/llm/*/kind=runs"
    before = set(glob.glob(folder))
    got = suffix_dedup.dedup(spark.createDataFrame(rows, SCHEMA), block=4000, group_max=50).collect()
    assert len(got) == 200 and all(len(passage) <= r["n_removed"] < len(passage) + 20 for r in got)
    (runs,) = set(glob.glob(folder)) - before
    per = [r["n"] for r in spark.read.parquet(runs).groupBy("range").agg(F.sum(F.length("lcp")).alias("n")).collect()]
    assert max(per) < sum(per) / 4


def test_pitman_yor(docs, rows, empty):
    got = pitman_yor.score(docs, block=300, part_bytes=4000).collect()
    assert len(got) == len(rows)
    train, text = Counter(), {}
    for i, t, _ in rows:
        ws = [w.lower() for w in words(t)] + [None]
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            train.update(ws)
        if i is not None:
            text[i] = ws
    n, v = sum(train.values()), len(train)
    for r in got:
        if r["doc_id"] is None:
            continue
        ws = text[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(train[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((train[w] + 1) / (n + v + 1)) for w in ws))
        assert r["score"] < 0
    again = pitman_yor.score(docs, block=300, part_bytes=4000).collect()
    assert sorted((r["n_tokens"], r["score"]) for r in again) == sorted((r["n_tokens"], r["score"]) for r in got)
    assert pitman_yor.score(empty).count() == 0


def _plain_pitman_yor(texts: dict, sweeps: int, burn_in: int) -> dict:
    """The same model by dictionaries, one dish at a time, with the same random numbers."""
    py, end = pitman_yor, int(pitman_yor.END)
    of = {w: int(py._tokens(w.encode())[1][0]) for t in texts.values() for w in t.split()}
    c = Counter()
    tokens = {i: [of[w] for w in t.split()] + [end] for i, t in texts.items()}
    for i, ws in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(zip([end, *ws], ws))

    def discount(n):
        one, two = sum(x == 1 for x in n), sum(x == 2 for x in n)
        return min(max(one / max(one + 2 * two, 1), 0.05), 0.95)

    def drawn(n, odds, d, word, context, sweep):
        key = py._key(np.array([word], np.uint64), np.array([context], np.uint64), sweep + py.SEED)
        t = 1
        for i in range(1, min(n, py.SINGLY)):
            t += py._uniform(key, i)[0] * (odds + i - d * t) < odds
        i = py.SINGLY
        while i < n:
            step = min(n - i, max(8, i // 8))
            t += py._binomial(np.array([step]), np.array([odds / (odds + i + step / 2 - d * t)]), key, i)[0]
            i += max(8, i // 8)
        return min(t, n)

    def summed(x, at):
        out = Counter()
        for pair, n in x.items():
            out[pair[at]] += n
        return out

    t, total = {pair: 1 for pair in c}, Counter()
    c0, held = summed(t, 1), summed(c, 0)
    t0, d0, d1, v = {w: 1 for w in c0}, discount(c0.values()), discount(c.values()), len(c0)
    asked = {pair for ws in tokens.values() for pair in zip([end, *ws], ws)}
    for s in range(sweeps + 1):
        tables, all0, top = summed(t, 0), sum(c0.values()), sum(t0.values())
        base = (1 + d0 * top) / (v + 1)
        root = lambda w: (c0[w] - d0 * t0.get(w, 0) + base) / (1 + all0)
        predict = lambda u, w: (c[u, w] - d1 * t.get((u, w), 0) + (1 + d1 * tables[u]) * root(w)) / (1 + held[u])
        for u in (*list(held)[:5], 12345):
            assert sum(predict(u, w) for w in c0) + predict(u, 1 << 63) == pytest.approx(1)
        if s > burn_in:
            total.update({pair: predict(*pair) / (sweeps - burn_in) for pair in asked})
        t = {(u, w): drawn(n, (1 + d1 * tables[u]) * root(w), d1, w, u, s) for (u, w), n in c.items()}
        # the root is drawn from the orders of the new tables, with its scalars of the sweep before
        c0 = summed(t, 1)
        t0 = {w: drawn(n, base, d0, w, w, s + 1) for w, n in c0.items()}
    return {i: sum(np.log10(total[pair]) for pair in zip([end, *ws], ws)) for i, ws in tokens.items()}


def test_pitman_yor_equals_plain_sampler(spark, monkeypatch):
    """Scores of the distributed sampler, its hot previous words spread or not, are those of the plain one."""
    rng = random.Random(9)
    texts = {i: " ".join(f"w{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(rng.randrange(30))) for i in range(60)}
    want = _plain_pitman_yor(texts, 4, 1)
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], SCHEMA)
    for spread, part in ((1 << 40, 1 << 20), (40, 300)):
        monkeypatch.setattr(pitman_yor, "SPREAD", spread)
        got = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs, block=200, part_bytes=part).collect()}
        assert got == pytest.approx(want, rel=1e-4)


def test_pitman_yor_group_draws():
    """Successes drawn in groups have a binomial's mean and spread, by inversion and by the normal."""
    key = pitman_yor._key(np.arange(20000, dtype=np.uint64), np.arange(20000, dtype=np.uint64), 1)
    for m, p in ((8, 0.3), (400, 0.01), (5000, 0.2)):
        k = pitman_yor._binomial(np.full(20000, m), np.full(20000, p), key, 48)
        assert k.min() >= 0 and k.max() <= m
        assert k.mean() == pytest.approx(m * p, rel=0.02) and k.var() == pytest.approx(m * p * (1 - p), rel=0.05)


def test_pitman_yor_keeps_previous_words_apart(spark):
    """Previous words that end alike are different contexts, however many there are."""
    rng = random.Random(4)
    rows = []
    for i in range(300):
        picks = [rng.randrange(50) for _ in range(40)]
        rows.append((i, " ".join(f"k{k}xyz v{k}" for k in picks), "s"))
    got = pitman_yor.score(spark.createDataFrame(rows, SCHEMA), block=4000, part_bytes=20000).collect()
    held = [r["score"] / 40 for r in got if r["held_out"]]
    # a draw of 50 words costs 1.7 decimal digits; the word after it is certain
    assert held and min(held) > -2.2


def test_toxicity(spark, empty):
    rng = random.Random(2)
    vocab = [f"w{i}x{i % 7}" for i in range(200)]
    rows, grades = [], []
    for i in range(400):
        ws = [rng.choice(vocab) for _ in range(30)]
        g = max(0, i % 6 - 3)
        for k in range(g * 3):
            ws[k] = rng.choice(["nasty", "horrid"] if k < 3 else ["vile", "fouls"]) + rng.choice(["er", "ly", ""])
        rows.append((i, " ".join(ws), "s"))
        grades.append((i, g if i % 7 < 4 else None))
    rows += [(1000, None, "s"), (1001, "", None), (None, "nasty vilely horrid", None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("toxicity", F.lit(0))
    model = toxicity.train(docs, spark.createDataFrame(grades + [(None, 2), (1, 0)], "doc_id long, grade int"))
    got = toxicity.score(docs, model)
    last = got.columns[-1]
    found = {r["doc_id"]: r for r in got.select("doc_id", f"{last}.*").collect()}
    unseen = [i for i in range(400) if i % 7 >= 4]
    assert np.mean([found[i]["grade"] == max(0, i % 6 - 3) for i in unseen]) > 0.9
    assert np.mean([found[i]["toxic"] == (i % 6 > 3) for i in unseen]) > 0.9
    assert not found[1000]["toxic"] and not found[1001]["toxic"] and found[None]["toxic"]
    assert all(a <= b for a, b in zip(model["cuts"], model["cuts"][1:]))
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, grade int"))
    assert not any(r["toxic"] for r in toxicity.score(docs, none).select(f"{last}.*").collect())
    assert toxicity.score(empty, model).count() == 0
