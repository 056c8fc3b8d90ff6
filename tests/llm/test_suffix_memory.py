"""What op2's Python workers hold at once: one block, a piece of its anchors, a slice of a hot group."""

from __future__ import annotations

import random

import numpy as np

from kpiforge.llm import suffix_dedup

SCHEMA = "doc_id long, text string"


def _texts(n: int, shared: str, rng: random.Random) -> list[tuple[int, str]]:
    around = lambda: "".join(rng.choice("abcdefghijklmnop ") for _ in range(400))
    return [(i, around() + shared + around()) for i in range(n)]


def _logging(monkeypatch, name: str, log, size) -> None:
    """Each call of the function, in the workers too, adds a line with ``size`` of its first argument and its caller."""
    real = getattr(suffix_dedup, name)

    def logged(x, *rest):
        import sys

        with open(log, "a") as f:
            f.write(f"{size(x, sys._getframe(1))}\n")
        return real(x, *rest)

    monkeypatch.setattr(suffix_dedup, name, logged)


def _numbers(log) -> list[int]:
    return [int(x) for x in log.read_text().split()]


def test_blocks_come_one_by_one(spark, monkeypatch, tmp_path):
    """A task with many blocks does not get them in one Arrow batch, be they broadcast to or shuffled."""
    rng = random.Random(4)
    shared = "".join(rng.choice("abcdefghijklmnop ") for _ in range(500))
    docs = spark.createDataFrame(_texts(120, shared, rng), SCHEMA).coalesce(1)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 8000, raising=False)
    _logging(monkeypatch, "_anchors_of", log := tmp_path / "rows", lambda _, frame: len(frame.f_locals["frame"]))
    for limit in (suffix_dedup.BROADCAST_BYTES, 0):
        monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", limit)
        got = suffix_dedup.dedup(docs, block=10_000).collect()
        assert len(got) == 120 and all(500 <= r["n_removed"] < 520 for r in got)
    assert len(_numbers(log)) > 20 and max(_numbers(log)) == 1


def test_windows_of_hot_groups_go_in_slices(spark, monkeypatch, tmp_path):
    """The windows of a group that Spark counts are not all held first, and all copies go."""
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdefghijklmnop ") for _ in range(300))
    docs = spark.createDataFrame(_texts(600, shared, rng), SCHEMA).coalesce(1)
    monkeypatch.setattr(suffix_dedup, "LATE_MAX", 40, raising=False)
    _logging(monkeypatch, "_window_hashes", log := tmp_path / "members", lambda group, _: len(group))
    got = suffix_dedup.dedup(docs, block=100_000, group_max=300).collect()
    assert len(got) == 600 and all(300 <= r["n_removed"] < 320 for r in got)
    assert sum(_numbers(log)) >= 600 and max(_numbers(log)) <= 40


def test_runs_of_a_block_are_made_in_pieces(monkeypatch):
    """Pieces of whole parts, none larger than PIECE unless one part is; together all anchors, each run sorted."""
    rng = np.random.default_rng(6)
    data = rng.integers(97, 100, 3000, dtype=np.uint8).tobytes()
    at = np.sort(rng.integers(60, 2800, 900))
    part = rng.integers(0, 50, 900)
    part[:300] = 7
    monkeypatch.setattr(suffix_dedup, "PIECE", 100)
    record = np.full(900, -1, dtype=np.int32)
    pieces = list(suffix_dedup._block_runs(data, at, at - 20, at, part, record, 40))
    runs = {p: r for found in pieces for p, r in found}
    assert sorted(runs) == sorted(set(part.tolist())) and sum(len(found) for found in pieces) == len(runs)
    for found in pieces:
        own = np.isin(part, [p for p, _ in found]).sum()
        assert own <= 100 or len(found) == 1
    for p, run in runs.items():
        entries = list(zip([s for _, s in run.suffixes()], run.lefts()))
        assert entries == sorted(set(entries))
        for i in np.flatnonzero(part == p):
            x = int(at[i])
            assert entries[record[i]] == (data[x : x + 40], data[x - 20 : x])
            assert bool(run.many[record[i]]) == (sum(record[part == p] == record[i]) > 1)
