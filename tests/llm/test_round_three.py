"""Periodic runs, spelling variants and secret scans against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiforge.llm import periodic, queries, secrets, variants

SCHEMA = "doc_id long, text string"


def brute_runs(words):
    out = []
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            part = words[i : i + length]
            smallest = not any(part[d:] == part[:-d] for d in range(1, q))
            if length >= max(6, 4 * q) and smallest:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rng = random.Random(11)
    out = []
    for letters in (1, 2, 3):
        for _ in range(60):
            out.append([rng.choice("abc"[:letters]) for _ in range(rng.randint(0, 60))])
    for _ in range(40):  # periods of every size, made of parts that repeat themselves
        unit = [rng.choice("ab") for _ in range(rng.randint(1, 4))] * rng.randint(1, 3) + [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        out.append([rng.choice("ab") for _ in range(5)] + unit * rng.randint(2, 7) + unit[: rng.randint(0, len(unit))])
    morse = [0]
    while len(morse) < 256:
        morse += [1 - x for x in morse]
    out.append([str(x) for x in morse])
    return out


def test_runs_equal_brute_force():
    for words in texts():
        ids = np.array([ord(w[0]) for w in words], dtype=np.int64)
        assert sorted(periodic.runs(ids), key=lambda r: (r[0], r[2])) == brute_runs(words)


def test_one_repeated_word_is_linear():
    assert periodic.runs(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]


def test_collapse_over_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK_WORDS", 40)
    rows = [(i, " ".join(ws)) for i, ws in enumerate(texts())]
    rows += [(None, "x " * 9), (None, None), (900, None), (901, ""), (902, " \n\t"), (903, "é é\né\té é é\x0bÉ"), (903, "é é\né\té é é\x0bÉ")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("periodic", F.lit(1)).withColumn("runs", F.lit("kept"))
    got = periodic.collapse(docs.repartition(3))
    assert got.columns == ["doc_id", "text", "periodic", "runs", "periodic_"]
    want = Counter()
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = brute_runs(words)
        want[(i, t, len(words), tuple(runs), collapsed(words, runs))] += 1
    found = Counter((r[0], r[1], r[4].n_words, tuple(map(tuple, r[4].runs)), r[4].text) for r in got.collect())
    assert found == want
    assert periodic.collapse(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with a small documents table of odd rows."""
    rng = random.Random(5)
    stems = ["".join(rng.choice("etaoins") for _ in range(rng.randint(5, 8))) for _ in range(60)]
    stems += [s + "e" for s in stems[:20]]
    say = lambda n: " ".join(rng.choice(stems) for _ in range(n))
    rows = [(i, say(rng.randint(0, 120)) + rng.choice([".\n", " ÉÀÿ× ", " ﬁnd ", ""])) for i in range(300)]
    rows += [(400, None), (401, ""), (None, say(50)), (None, None), (402, rows[1][1]), (402, rows[1][1])]
    rows += [(403, "token = abcdef, Secret:'q1w2e3' PASSWD=abc api_key=\"" + "9f" * 20 + "\" AKIA" + "Z9" * 8)]
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, SCHEMA).withColumn("spans", F.lit(1)).withColumn("word", F.lit("x")).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def test_op11_query(spark, tables):
    folder, rows = tables
    want = Counter()
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        n = len(words)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
        runs = brute_runs(words)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        milli = 1000 * top[1] // top[2] if runs else None
        want[(i, len(runs), *top, milli, sha(listed), sha(collapsed(words, runs)))] += 1
    got = queries.op11_periodic_runs(spark, folder)
    assert dict(got.dtypes)["exponent_milli"] == "bigint"
    assert Counter(map(tuple, got.collect())) == want
    assert sum(1 for k in want if k[1]) > 10


def brute_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    out = {}
    near = {w: [v for v in counts if brute_near(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v.encode())) if vs else None
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        f = form[w]
        out[w] = (f, root, counts[w], len(near[w]), counts[f] if f is not None else None)
    return out


@pytest.mark.parametrize("how", [{}, {"top": 1, "cell_words": 3}, {"top": 3, "cell_words": 40}])
def test_variants_equal_brute_force(spark, how):
    rng = random.Random(2)
    vocab = {"".join(rng.choice("eté") for _ in range(rng.randint(6, 7))) for _ in range(400)}
    vocab |= {"aaaaaa", "aaaaaaa", "abcdef", "abcdeg", "bbcdef", "zzzzzz", "zzzzzzz", "zzzzzzzz"}
    # chains of forms: each word five times as frequent as the next
    extra = {"zzzzzz": 5, "zzzzzzz": 25, "zzzzzzzz": 125}
    rows = [(w,) for w in sorted(vocab) for _ in range(extra.get(w, rng.choice([4, 5, 6, 30, 200])))]
    rows += [(None,)] * 9 + [("",)] * 9 + [("short",)] * 9
    counts = {w: n for w, n in Counter(r[0] for r in rows).items() if w and len(w) >= 6 and n >= 5}
    tokens = spark.createDataFrame(rows, "word string").withColumn("n", F.lit(1)).withColumn("root", F.lit("x"))
    got = {r["word"]: tuple(r)[1:] for r in variants.group(tokens.repartition(3), **how).collect()}
    want = brute_variants(counts)
    assert got == want
    assert got["zzzzzz"][1] == "zzzzzzzz" and max(v[3] for v in got.values()) > 5


def test_large_leaves_are_searched_by_halves(monkeypatch):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("xyz") for _ in range(rng.choice([7, 8]))) for _ in range(400)})
    leaf = variants.Leaf()
    leaf.words = [(w, 1) for w in words if len(w) == 8]
    for w in words:
        want = {v for v, _ in leaf.words if variants.near(w, v)}
        assert {v for v, _ in leaf.candidates(w) if variants.near(w, v)} == want == {v for v, _ in leaf.words if brute_near(w, v)}


def test_variants_without_words(spark):
    assert variants.group(spark.createDataFrame([(None,)], "word string")).count() == 0


def test_op12_query(spark, tables):
    folder, rows = tables
    found = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    counts = {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}
    got = queries.op12_spelling_variants(spark, folder)
    assert {r["word"]: tuple(r)[1:] for r in got.collect()} == brute_variants(counts)
    assert any(r["n_near"] for r in got.collect())


def brute_entropy_spans(s, cls):
    hot = []
    for i in range(len(s) - cls.window + 1):
        w = s[i : i + cls.window]
        bits = -sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values())
        lower, upper, digits = (sum(map(f, w)) for f in (str.islower, str.isupper, str.isdigit))
        if bits >= cls.bits - 1e-6 and digits >= cls.digits and lower >= cls.lower and upper >= cls.upper and lower + upper >= cls.letters:
            if hot and hot[-1][1] >= i:
                hot[-1] = (hot[-1][0], i + cls.window)
            else:
                hot.append((i, i + cls.window))
    return hot


def brute_base(text):
    out = []
    for kind, pattern, group, least in secrets.BASE:
        flags = re.I | re.A if kind == "assign" else 0
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k in [kind] for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
    order = [b[0] for b in secrets.BASE]
    return sorted(out, key=lambda x: (x[0], order.index(x[1])))


def test_window_entropy_equals_brute_force():
    rng = random.Random(8)
    for cls in secrets.CLASSES:
        alphabet = [c for c in map(chr, range(33, 127)) if re.fullmatch(f"[{cls.characters}]", c)]
        for _ in range(120):
            s = "".join(rng.choice(alphabet[: rng.randint(1, len(alphabet))]) for _ in range(rng.randint(0, 90)))
            assert secrets.hot_spans(s, cls) == brute_entropy_spans(s, cls)


def test_scanner_finds_keys_and_leaves_text_alone():
    scan = secrets.Scanner().spans
    rng = random.Random(1)
    make = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    caught = sum(bool(scan(f"ünder key {make(b64, 40)} end")) for _ in range(200))
    assert caught >= 196
    assert sum(bool(scan(f"id {make('0123456789ABCDEF', 32)}.")) for _ in range(200)) >= 196
    assert sum(bool(scan(f"id {make('0123456789abcdefghijklmnopqrstuvwxyz', 32)}.")) for _ in range(200)) >= 190
    for clean in (
        "pneumonoultramicroscopicsilicovolcanoconiosis and donaudampfschifffahrtsgesellschaft",
        "https://site.org/some-long-path/of-words/that-reads-like-a-title-2024",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
        "id 3F2504E0-4F89-41D3-9A0C-0305E82C3301 sha256: 9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B2B0B822CD15D6C15B0F00A08",
        "key EXAMPLE" + "kX9fQ2mZ7pL4vB8nR3tY", "",
    ):
        assert scan(clean) == [], clean
    # numbers are no candidates of the entropy classes; the fixed hex pattern takes them
    assert [k for k, *_ in scan("0" * 32 + " " + "1234567890" * 4)] == ["hex", "hex"]
    # entropy spans inside a fixed pattern's span are not given twice
    key = make(b64, 40).replace("+", "a").replace("/", "b")
    assert [k for k, *_ in scan(f"token={key}")] == ["assign"]


def test_op13_query(spark, tables):
    folder, rows = tables
    got = queries.op13_secret_scans(spark, folder).collect()
    want = Counter()
    for i, t in rows:
        base = brute_base(t or "")
        sha = hashlib.sha256(",".join(b[2] for b in base).encode()).hexdigest()
        want[(i, *(sum(b[1] == k for b in base) for k in ("assign", "access", "hex")), sha)] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    for r in got:
        assert (not r["spans"]) == (r["n_assign"] + r["n_access"] + r["n_hex"] == 0)
    assert sum(r["n_access"] for r in got) == 1 and sum(r["n_assign"] for r in got) == 3
    assert secrets.scan(spark.createDataFrame([], SCHEMA)).count() == 0
