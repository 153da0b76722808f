import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import money, period, text


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_signature_drops_references_and_rails(spark):
    rows = ["UPI/4444xx/Tea  Stall/REF no 12", "neft é1234 café", "ABC def 9*9*9* x", "premium", ""]
    assert values(spark, text.signature, rows) == ["tea stall", "caf", "abc def x", "premium", ""]


def test_signature_passes_a_text_three_times(spark):
    """Blanks, masked runs with and without an x, and rail words side by side; the text is passed by no more patterns than it needs."""
    rows = ["upi ref\u3000no id", "12xx34 tea xxxx-9999", "a**12x·b", "rsx rs  txn\tdt", "x9", "no\u00a0neftno no", "****x", None]
    assert values(spark, text.signature, rows) == ["", "tea", "a b", "rsx", "x", "neftno", "x", None]
    plan = spark.createDataFrame([("a",)], "v string").select(text.signature(F.col("v")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") == 3


def test_words_are_ascii_bounded(spark):
    assert values(spark, lambda c: text.contains_word(c, F.lit("emi")), ["EMI/04/24", "premium", "éemi", "e.m.i"]) == [True, False, True, False]
    assert values(spark, lambda c: text.contains_word(c, F.lit("a.b")), ["x a.b y", "x aXb y"]) == [True, False]
    gas = dict((k[0], k) for k in fv.KEYWORD_RULES)["gas"][0]
    assert values(spark, lambda c: text.keyword_match(c, gas), ["gastro pub", "hp gas"]) == [False, True]
    assert values(spark, lambda c: text.keyword_match(c, "cred.club"), ["x@cred.clubs", "credXclub"]) == [True, False]


def test_clean_label(spark):
    rows = ["12:30 UPI/abc123456/Corner Shop/REF# 99", "(ref# 12) Book Store LTD 30", "9999999", "One two three four five six seven eight nine"]
    got = values(spark, text.clean_label, rows)
    assert got == ["Corner Shop", "Book Store", "9999999", "One two three four five six seven"]


def test_clean_label_takes_each_step_once(spark):
    """What is named several times is made once; edges, blanks and case as before."""
    rows = ["xref 12 REF#7a_b tea", "abc1234_ abc12345 _12345 12345 c  L house", "Tea\u00a0\t ACH\u3000Stall  of 12", "upi/pos", None, "", "  ", "a" * 40, "É1234567 1234567É"]
    got = values(spark, text.clean_label, rows)
    assert got == ["xref 12 tea", "abc1234_ _12345 c L house", "Tea Stall", "upi/pos", None, "", "", "a" * 36, "É É"]
    plan = spark.createDataFrame([("x",)], "c string").select(text.clean_label(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[+|*/@]") <= 2  # once, and once more as the array whose size `let` asks for


def test_title_and_labels(spark):
    assert values(spark, text.title_case, ["one-two three's", ""]) == ["One-Two Three'S", ""]
    assert values(spark, text.category_label, ["mobile_internet", "Transfer", "food_delivery", "rent"]) == [
        "Mobile & Internet", "Transfer", "Food Delivery", "Rent",
    ]
    assert values(spark, text.normalize_category, ["Cash", "expenses.x.food-delivery", " Rent ", "what", None]) == [
        "atm_cash", "food_delivery", "rent", "uncategorised", "uncategorised",
    ]


def test_token_prefix_is_whole_token_and_proper(spark):
    df = spark.createDataFrame([("a b", "a b c"), ("a b", "a bc"), ("a", "a"), ("", "a"), ("a b c", "a b")], "a string, b string")
    assert [r[0] for r in df.select(text.is_token_prefix(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, True]


def test_fiscal_year_edges(spark):
    days = [datetime.date(1999, 3, 31), datetime.date(1999, 4, 1), datetime.date(2000, 2, 29), datetime.date(2099, 12, 31)]
    assert values(spark, period.fy_key, days, "date") == ["1998-99", "1999-00", "1999-00", "2099-00"]


@pytest.mark.parametrize(
    "day,cadence,expected",
    [("2023-01-31", "monthly", "2023-02-28"), ("2024-01-31", "monthly", "2024-02-29"), ("2023-11-30", "quarterly", "2024-02-29"),
     ("2024-02-29", "yearly", "2025-02-28"), ("2023-02-28", "monthly", "2023-03-28")],
)
def test_cadence_clamps_to_month_end(spark, day, cadence, expected):
    got = values(spark, lambda c: period.add_cadence(c.cast("date"), F.lit(cadence)), [day])
    assert got[0].isoformat() == expected


def test_statement_dates_are_real_days(spark):
    df = spark.createDataFrame([("31", "02", "2025"), ("29", "02", "24"), ("01", "13", "24"), ("01", "01", "1999"), ("99", "99", "99")], "d string, m string, y string")
    got = [r[0] for r in df.select(period.statement_date(F.col("d"), F.col("m"), F.col("y"))).collect()]
    assert got == [None, datetime.date(2024, 2, 29), None, None, None]


def test_rounding_goes_up_on_halves(spark):
    assert values(spark, money.to_major, [250, -250, -251, 49, 50, None], "bigint") == [3, -2, -3, 0, 1, 0]
    assert values(spark, money.js_round, [2.5, -2.5, 0.49], "double") == [3, -2, 0]
    assert values(spark, money.to_minor, ["1,80,000.5", "12", "x"]) == [18000050, 1200, None]


def test_bytes_and_bands(spark):
    assert values(spark, money.human_bytes, [0, 1023, 1536, 10 * 1024, 5 * 1024**3], "bigint") == ["0 B", "1023 B", "1.5 KB", "10 KB", "5.0 GB"]
    assert values(spark, money.amount_bucket, [9_949, 9_950, -2_500_000], "bigint") == ["income:0-100", "income:100-500", "expense:25000+"]


def test_long_ids_stay_apart(spark):
    from ledgerloom.operators import tables

    long = "x" * 200
    df = spark.createDataFrame([(long + "1",), (long + "2",), ("short",)], "t string")
    ids = [r.i for r in df.select(text.stable_id(60, "pred", F.col("t")).alias("i")).collect()]
    assert len(set(ids)) == 3 and "pred_short" in ids and max(map(len, ids)) == 60
    known = spark.createDataFrame([(1, "old", 5)], "k int, a string, b int")
    fresh = spark.createDataFrame([(1, "z", 1), (1, "m", 2), (2, "n", 3), (2, "n", 3)], "k int, a string, b int")
    got = sorted(tuple(r) for r in tables.upsert(known, fresh, ["k"], ["a"]).collect())
    assert got == [(1, "m", 5), (2, "n", 3)]
