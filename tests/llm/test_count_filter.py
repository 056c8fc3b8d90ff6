"""The byte-position index of SimHash: the tally rejects pairs, and links join what brute force joins."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from kpiforge.llm import simhash


def planted(seed, n):
    """Fingerprints with many that share bytes: some within 2 bits, some just beyond."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 62, 12, dtype=np.uint64)
    out = list(base)
    while len(out) < n:
        x = int(out[rng.integers(0, len(out))])
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= 1 << int(b)
        out.append(np.uint64(x))
    return np.unique(np.array(out, dtype=np.uint64))


def partition(pairs, members):
    root = {int(m): int(m) for m in members}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(int(a)), find(int(b))
        root[max(a, b)] = min(a, b)
    return {m: find(m) for m in root}


def brute(members, bits):
    return [(a, b) for a, b in combinations(members.tolist(), 2) if (a ^ b).bit_count() <= bits]


def test_every_pair_within_bits_meets_in_a_list():
    for bits in range(1, 8):
        groups = simhash.groups_of(bits)
        assert sorted(sum(groups, ())) == list(range(8))
        for differ in combinations(range(8), bits):
            assert sum(not set(g) & set(differ) for g in groups) >= len(groups) - bits


def test_the_tally_rejects_pairs():
    a = np.array([0x0102030405060708] * 3, dtype=np.uint64)
    b = a ^ np.array([0x03, 0x010100, 0x010101], dtype=np.uint64)
    assert simhash.tally(a, b).tolist() == [7, 6, 5]
    members = planted(3, 200)
    left, right = (members[i] for i in np.triu_indices(len(members), 1))
    listed = np.zeros(len(left), dtype=bool)
    for two in combinations(simhash.groups_of(2), 2):
        mask = np.uint64(sum(0xFF << (8 * p) for p in sum(two, ())))
        listed |= (left & mask) == (right & mask)
    rejected = listed & (simhash.tally(left, right) < 6)
    assert rejected.sum() > 50  # candidates of the index that the count filter drops
    near = np.bitwise_count(left ^ right) <= 2
    assert not (rejected & near).any() and not (near & ~listed).any()


@pytest.mark.parametrize("dense, hot", [(256, 1 << 16), (4, 1 << 16), (4, 20), (256, 3)])
def test_links_equal_brute_force(spark, monkeypatch, dense, hot):
    members = planted(7, 400)
    monkeypatch.setattr(simhash, "DENSE", dense)
    for bits in (1, 2, 3):
        forest = simhash._Forest(members, bits)
        forest.grow(np.arange(len(members)), ())
        assert partition(forest.links(), members) == partition(brute(members, bits), members)
    fps = spark.createDataFrame([(int(m),) for m in members.view(np.int64)], "fp long")
    got = [(np.int64(r["u"]).astype(np.uint64), np.int64(r["v"]).astype(np.uint64)) for r in simhash.links(fps, 2, hot).collect()]
    assert partition(got, members) == partition(brute(members, 2), members)
