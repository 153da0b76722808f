import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import tax


def total(spark, regime, taxable):
    df = tax.regime_tax(spark.createDataFrame([(taxable,)], "x bigint"), F.col("x"), regime)
    return df.first().asDict()


@pytest.mark.parametrize(
    "regime,taxable,expected",
    [
        ("new", 1_600_000, {"new_tax": 120_000, "new_cess": 4_800, "new_total": 124_800}),
        ("new", 1_210_000, {"new_tax": 10_000, "new_rebate": 51_500.0, "new_total": 10_400}),
        ("old", 1_000_000, {"old_total": 117_000}),
        ("old", 500_000, {"old_rebate": 12_500.0, "old_total": 0}),
        ("new", 1_200_000, {"new_total": 0}),
        ("old", -5, {"old_taxable": 0, "old_total": 0}),
        ("old", 60_000_000, {"old_surcharge": 6_590_625}),
        ("new", 60_000_000, {"new_surcharge": 4_395_000}),
    ],
)
def test_regimes(spark, regime, taxable, expected):
    got = total(spark, regime, taxable)
    assert {k: got[k] for k in expected} == expected


def test_caps_apply_per_row(spark):
    rows = [("80C", 220_000), ("80C", 140_000), ("HRA", 900_000), ("24(b)", 250_000)]
    got = [(r.section, r.amount) for r in tax.capped(spark.createDataFrame(rows, "section string, raw_amount bigint")).collect()]
    assert got == [("80C", 150_000), ("80C", 140_000), ("HRA", 900_000), ("24(b)", 200_000)]


def test_rent_allowance(spark):
    rows = [(240_000, None, None, None), (240_000, 200_000, None, None), (240_000, 200_000, 600_000, "metro"), (50_000, 200_000, 600_000, "non_metro")]
    df = spark.createDataFrame(rows, "rent bigint, got bigint, basic bigint, city string")
    claim = tax.hra_exemption(F.col("rent"), F.col("got"), F.col("basic"), F.col("city"))
    assert [r[0] for r in df.select(claim).collect()] == [0, 200_000, 180_000, 0]


def test_tie_recommends_the_old_regime(spark):
    df = spark.createDataFrame([(0, 0, 0)], "gross bigint, itemised bigint, employer_nps bigint")
    row = tax.compare_regimes(df).first()
    assert (row.recommended, row.saving) == ("old", 0)
