"""Mean vectors against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import vectors
from ledgerloom.operators import labels


def plain(rows):
    sums = {}
    for owner, label, vector in rows:
        for i, x in enumerate(vector or []):
            cells = sums.setdefault((owner, label), {})
            cells.setdefault(i, [])
            if x is not None:
                cells[i].append(x)
    return {k: [sum(c[i]) / len(c[i]) if c[i] else None for i in range(len(c))] for k, c in sums.items()}


@pytest.mark.parametrize("limits", [{}, {"held_values": 1, "salts": 2}])
def test_against_a_loop(spark, limits):
    rng = random.Random(2)
    value = lambda: rng.choice([None, rng.uniform(-1, 1), 1.0, 0.0])
    # a third of all rows has one key; vectors differ in size
    rows = [(rng.choice([1, 1, 2, 3, None]), rng.choice(["a", "b", None]), [value() for _ in range(rng.choice([0, 1, 3, 5]))]) for _ in range(600)]
    rows += [(1, "a", [0.5, 0.25, 1.0])] * 300 + [(7, "none", None), (7, "empty", []), (7, "nulls", [None, None]), (7, "one", [2.0])]
    frame = spark.createDataFrame(rows, "owner_id long, label string, vector array<double>").repartition(7).withColumn("extra", F.lit(1))
    found = vectors.mean_vectors(frame, ["owner_id", "label"], F.col("vector"), "mean", **limits)
    assert found.columns == ["owner_id", "label", "mean"]
    got = {(r.owner_id, r.label): r["mean"] for r in found.collect()}
    want = plain(rows)
    assert got.keys() == want.keys() and len(got) == found.count()
    for key, mean in want.items():
        assert [x is None for x in got[key]] == [x is None for x in mean]
        assert [x for x in got[key] if x is not None] == pytest.approx([x for x in mean if x is not None])
    assert vectors.mean_vectors(frame.limit(0), ["owner_id", "label"], F.col("vector"), "mean", **limits).count() == 0


def test_no_row_per_dimension(spark):
    frame = spark.createDataFrame([(1, 1, [3.0, 4.0])], "owner_id long, mask int, vector array<double>")
    pooled = labels.pool_tokens(frame, ["owner_id"])
    assert "Generate" not in pooled._jdf.queryExecution().optimizedPlan().toString()
    assert pooled.first().vector == pytest.approx([0.6, 0.8])
