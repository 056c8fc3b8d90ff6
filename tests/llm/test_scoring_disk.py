"""What op4 keeps on disk at once: its stored tables and the shuffles beside them."""

from __future__ import annotations

import random
from pathlib import Path

from kpiforge.llm import pitman_yor
from kpiforge.session import checkpoint_dir


def test_pitman_yor_shuffles_a_share_at_a_time(spark, monkeypatch):
    """No step holds much more than the blocks did: parts are merged and predicted in rounds, and what is done is deleted."""
    rng = random.Random(3)
    vocab = [f"{rng.getrandbits(40):x}" for _ in range(30000)]
    pick = lambda: vocab[min(int(rng.paretovariate(0.25)), len(vocab)) - 1]
    rows = [(i, " ".join(pick() for _ in range(200)), "s") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).localCheckpoint()
    folder = Path(checkpoint_dir(spark).removeprefix("file://")) / "llm"
    local = [Path(d.getPath()) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    before, steps, real = set(folder.glob("*")), [], pitman_yor.stored

    def tables() -> int:
        return sum(p.stat().st_size for d in set(folder.glob("*")) - before for p in d.rglob("*.parquet"))

    def shuffles() -> dict:
        return {p.name: p.stat().st_size for d in local for p in d.rglob("shuffle_*.data") if p.exists()}

    known = set()

    def measured(df, by=None):
        known.update(shuffles())
        out = real(df, by)
        steps.append(tables() + sum(n for name, n in shuffles().items() if name not in known))
        known.update(shuffles())
        return out

    monkeypatch.setattr(pitman_yor, "stored", measured)
    got = pitman_yor.score(docs, block=100_000, part_bytes=600_000).collect()
    steps.append(tables() + sum(n for name, n in shuffles().items() if name not in known))
    assert len(got) == 2000
    # the final step, all pairs' predictions and the texts in a shuffle, holds 2.25 times the blocks
    assert max(steps) < 2.5 * steps[0]
