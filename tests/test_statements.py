"""Statement text in, rows out; every text is invented."""

import datetime

from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.sources import statements

SCHEMA = "owner_id bigint, document_id string, text string, opening_balance bigint, doc_type string"


def parse(spark, body, opening=None):
    docs = spark.createDataFrame([(1, "d", body, opening, "bank_statement")], SCHEMA)
    parsed = statements.parse_statements(docs).orderBy("row_no", "piece_no").collect()
    good = [(r.txn_date.isoformat(), r.amount, r.raw_description) for r in parsed if r.reject is None]
    return good, [(r.reject, r.raw) for r in parsed if r.reject is not None], parsed


def test_balance_layout_signs_by_delta(spark):
    good, bad, _ = parse(spark, "header\n01/04/2024 Tea 100.00 900.00\n02/04/2024 Pay 50.00 950.00\n03/04/24 no money here\n04/04/2024 Single 20.00\n05/04/2024 Book 10.00 940.00")
    assert good == [("2024-04-01", -10000, "Tea"), ("2024-04-02", 5000, "Pay"), ("2024-04-04", -2000, "Single"), ("2024-04-05", -1000, "Book")]
    assert bad == [("no money", "03/04/24 no money here")]


def test_card_layout_reads_words(spark):
    good, _, _ = parse(spark, "01/04/2024 Dr. Mehta clinic 500.00\n02/04/2024 REFUND shoes 250.00 Cr\n03/04/2024 cafe 99.50 Dr")
    assert good == [("2024-04-01", -50000, "Dr. Mehta clinic"), ("2024-04-02", 25000, "REFUND shoes"), ("2024-04-03", -9950, "cafe")]


def test_wraps_orphans_and_merges(spark):
    body = "\n".join(
        [
            "01/04/2024 First 10.00 990.00", "UPI/for the second", "02/04/2024 Second 20.00 970.00", "tail of second",
            "03/04/2024 Third 30.00 940.00 10/04/2024 Fourth 40.00 900.00", "IMPS/left over",
        ]
    )
    good, _, _ = parse(spark, body, 100_000)
    assert good == [
        ("2024-04-01", -1000, "First"), ("2024-04-02", -2000, "Second UPI/for the second tail of second"),
        ("2024-04-03", -3000, "Third"), ("2024-04-10", -4000, "Fourth IMPS/left over"),
    ]


def test_value_date_column_is_not_a_second_row(spark):
    good, _, _ = parse(spark, "01/04/2024 02/04/2024 Lunch 45.00\n03/04/2024 99/99/99 ref 12.00")
    assert [g[0] for g in good] == ["2024-04-01", "2024-04-03"]


def test_furniture_repeats_and_caps(spark):
    body = "01/04/2024 Opening Balance 5.00\n02/04/2024 Shop 7.00\n02/04/2024 Shop 7.00\n03/04/2024 Void 0.00\n04/04/2024 Big 200,000,000,000.00"
    good, bad, _ = parse(spark, body)
    assert good == [("2024-04-02", -700, "Shop")]
    assert [b[0] for b in bad] == ["furniture", "repeat", "amount out of range", "amount out of range"]


def test_references_are_not_amounts(spark):
    good, _, parsed = parse(spark, "01/04/2024 NEFT DR-BANK0001-ASHA RAO-778899 123456789012 1,80,000.00\n02/04/2024 pay tea.stall@okbank 2400")
    assert [(g[0], g[1]) for g in good] == [("2024-04-01", -18000000), ("2024-04-02", -240000)]
    assert [r.counterparty_raw for r in parsed] == ["ASHA RAO", "tea.stall@okbank"]


def header(spark, body):
    docs = spark.createDataFrame([(1, "d", body, None, "bank_statement")], SCHEMA)
    row = statements.header_facts(docs).first()
    return row.account_last4, row.doc_type


def test_header_numbers(spark):
    assert header(spark, "My Bank\nA/c No: XXXXXX7702\n01/04/2024 x 1.00") == ("7702", "bank_statement")
    assert header(spark, "Statement for your Credit Card\n4375XXXXXXXX9012\n") == ("9012", "card_statement")
    assert header(spark, "x\n1234567890123456\n01/04/2024 NEFT a/c no XXXX1111 1.00") == (None, "bank_statement")


def test_parser_dispatch(spark):
    def other(docs):
        return statements.parse_statements(docs).withColumn("currency", F.lit("USD"))

    rows = [(1, "d1", "01/04/2024 a 1.00", None, "bank_statement", "p"), (1, "d2", "02/04/2024 b 2.00", None, "bank_statement", "q")]
    docs = spark.createDataFrame(rows, SCHEMA + ", provider_id string")
    out = statements.parse_with(docs, {"p:bank_statement": other}).collect()
    assert sorted((r.document_id, r.txn_date, r.currency) for r in out) == [
        ("d1", datetime.date(2024, 4, 1), "USD"), ("d2", datetime.date(2024, 4, 2), "INR"),
    ]


def test_header_regexes_run_once_per_line(spark):
    """The lines are split once and each line is matched once; edges of dates and account numbers keep their results."""
    rows = [
        (1, "d1", "Top\r\nXXXX-XXXX 123456\n01/04/2024 a 1.00", None, "bank_statement"), (1, "d2", "01/04/2024 a 1.00\nXXXXXXXX1234", None, "bank_statement"),
        (1, "d3", "99/99/2024 1.00\nXXXXXXXX 1234", None, "bank_statement"), (1, "d4", None, None, "x"), (1, "d5", "01/04/24 2.00", None, "x"), (1, "d6", "XXXXXXXX 987", None, "x"),
    ]
    documents = spark.createDataFrame(rows, "owner_id long, document_id string, text string, opening_balance long, doc_type string")
    facts = statements.header_facts(documents)
    got = {r.document_id: r.account_last4 for r in facts.collect()}
    assert got == {"d1": "3456", "d2": None, "d3": "1234", "d4": None, "d5": None, "d6": None}
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("gettimestamp") <= 1 and plan.count("split(") <= 2
    days = spark.createDataFrame([("x 31/01/99 y",), ("31-02-2024",), ("1/2/2024",), ("",), (None,), ("05/06/1999",)], "v string")
    assert [str(r[0]) for r in days.select(statements.date_of(F.col("v"))).collect()] == ["2099-01-31", "None", "None", "None", "None", "None"]


def test_a_cleaned_text_is_asked_like_a_raw_one(spark):
    texts = spark.createDataFrame([("  Blue\u00a0 GEAR ring",), ("geared",), ("",), (None,)], "raw string")
    raw, cleaned = F.col("raw"), text.clean(F.col("raw"))
    for ask in (lambda *a: text.contains(a[0], F.lit("Gear"), *a[1:]), lambda *a: text.contains_word(a[0], F.lit("Gear"), *a[1:]),
                lambda *a: text.contains_any(a[0], F.array(F.lit("Gear"), F.lit(None)), *a[1:])):
        both = texts.select(ask(raw).alias("a"), ask(cleaned, True).alias("b")).collect()
        assert [r.a for r in both] == [r.b for r in both] and both[0].a


def test_tasks_follow_the_size_of_the_text(spark):
    """However many documents a task gets, repeated and null keys included, the rows are the same."""
    bodies = [f"0{d}/04/2024 Tea {d}.00 900.00\n0{d}/05/2024 Pay 50.00 950.00\nwrapped" for d in range(1, 9)]
    docs = spark.createDataFrame([(1, f"d{i % 7}" if i else None, body, 5, "bank_statement") for i, body in enumerate(bodies)], SCHEMA)
    _, spread = statements.dealt(docs, 10)
    assert spread.rdd.getNumPartitions() == -(-sum(map(len, bodies)) // 10)
    rows = [sorted(map(str, statements.parse_statements(docs, size).collect())) for size in (10, 8_000_000)]
    assert rows[0] == rows[1] and rows[0]
