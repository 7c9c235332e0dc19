"""What downstream impact writes between jobs, and its counts from common records."""

from __future__ import annotations

import random

import pytest

from tests.test_assurance import GRAPHS, plain_impact
from veriframe.operators import impact


def test_outer_records_are_not_written_between_jobs(spark, monkeypatch):
    """Records that nothing depends on are placed once, by their source, and are no part of levels, cycles or numbers."""
    edges = [(f"CR-{i}", f"URS-{(i * k) % 40}") for i in range(1_000) for k in (1, 7)] + [(f"URS-{i}", f"TC-{i % 5}") for i in range(40)]
    written = []
    whole = impact.checkpointed

    def counted(df):
        out = whole(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(impact, "checkpointed", counted)
    got = impact.downstream_impact(spark.createDataFrame(edges, "source_id string, target_id string"))
    assert sorted(tuple(r)[:9] for r in got.collect()) == plain_impact(edges)
    assert written and sum(written) < 1_000


@pytest.mark.parametrize("rows", [0, 500_000])
@pytest.mark.parametrize("name", ["diamonds", "cycles", "random"])
def test_common_records(spark, monkeypatch, name, rows):
    """Whether common records are broadcast or not; edges are repeated."""
    monkeypatch.setattr(impact, "COMMON", 2)
    monkeypatch.setattr(impact, "BROADCAST_ROWS", rows)
    rng = random.Random(9)
    edges = GRAPHS.get(name) or [(f"CR-{rng.randrange(40)}", f"URS-{rng.randrange(9)}") for _ in range(60)] + [(f"URS-{rng.randrange(9)}", f"{k}-{rng.randrange(9)}") for k in ("TC", "URS", "ACC") for _ in range(8)]
    got = impact.downstream_impact(spark.createDataFrame(edges * 2, "source_id string, target_id string"))
    assert sorted(tuple(r)[:9] for r in got.collect()) == plain_impact(edges)
