"""Balance chains, missing months, later corrections and transfer closure against serial loops."""

import datetime
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import completeness, scans, transfers
from ledgerloom.plans import completeness_queries as q, integrity_queries

DAY = datetime.date(2024, 1, 1)
CHAIN = "owner_id long, own_account_id string, txn_id string, txn_date date, seq long, amount long, balance long"
SF_DIR = "/root/testdata/sf0.001"


def serial_breaks(rows, tolerance=0):
    found, state = {}, {}
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0], r[1], r[3] or datetime.date.min, r[4], r[2])):
        known, moved = state.get(r[:2], (None, 0))
        moved += r[5] or 0
        if r[6] is None:
            state[r[:2]] = (known, moved)
            continue
        if known is not None and abs(r[6] - known - moved) > tolerance:
            found[r[2]] = (known + moved, r[6] - known - moved)
        state[r[:2]] = (r[6], 0)
    return found


def chain_rows(n, accounts, seed):
    rng = random.Random(seed)
    rows, balance = [], defaultdict(int)
    for i in range(n):
        account = (rng.randrange(2), rng.choice(accounts))
        amount = rng.choice([None, rng.randint(-500, 500)])
        balance[account] += amount or 0
        if rng.random() < 0.02:
            balance[account] += rng.randint(-3, 3)  # something is missing
        date = None if i < 3 else DAY + datetime.timedelta(days=i // 20)
        rows.append((*account, f"t{i:05}", date, i, amount, balance[account] if rng.random() < 0.6 else None))
    return rows


@pytest.mark.parametrize("accounts", [["hot"], ["a", "b", "c", None], [f"a{i}" for i in range(150)]], ids=["one hot account", "few", "many"])
def test_chain_against_a_loop(spark, accounts):
    rows = chain_rows(1500, accounts, len(accounts))
    frame = spark.createDataFrame(rows, CHAIN)
    for tolerance in (0, 2):
        chain = completeness.balance_chain(frame, tolerance, slices=9)
        assert chain.count() == sum(r[1] is not None for r in rows)
        got = {r.txn_id: (r.expected_balance, r.difference) for r in chain.filter("broken").collect()}
        assert got == serial_breaks(rows, tolerance)
    cards = completeness.balance_card(completeness.balance_chain(frame, slices=9)).agg(F.sum("breaks"), F.sum("rows")).first()
    assert tuple(cards) == (len(serial_breaks(rows)), sum(r[1] is not None for r in rows))


def test_a_hot_account_is_in_many_slices(spark):
    frame = spark.createDataFrame(chain_rows(2000, ["hot"], 5), CHAIN).withColumn("owner_id", F.lit(1))
    sizes = scans.sliced(frame, completeness.ACCOUNT, completeness.CHAIN, 8).groupBy("_slice").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 600


def test_a_deleted_row_and_a_deleted_month_are_found(spark):
    rows = [(1, "a", f"t{i:03}", DAY + datetime.timedelta(days=10 * i), i, 5, 5 * (i + 1)) for i in range(40)]
    whole = spark.createDataFrame(rows, CHAIN)
    assert completeness.balance_chain(whole).filter("broken").isEmpty() and completeness.month_gaps(whole).isEmpty()
    torn = whole.filter("not (month(txn_date) = 5 and year(txn_date) = 2024)")
    assert [r.difference for r in completeness.balance_chain(torn).filter("broken").collect()] == [5 * sum(r[3].month == 5 and r[3].year == 2024 for r in rows)]
    gap = completeness.month_gaps(torn).collect()
    assert [tuple(g) for g in gap] == [(1, "a", datetime.date(2024, 5, 1), datetime.date(2024, 5, 1), 1)]
    card = {r.fy_key: (r.seen, r.missing) for r in completeness.month_completeness(torn).collect()}
    assert card == {"2023-24": (3, 0), "2024-25": (9, 1)}


def test_years_inside_a_gap_are_listed(spark):
    rows = [(1, "a", "x", datetime.date(2019, 12, 31), 1, 1, None), (1, "a", "y", datetime.date(2023, 4, 1), 2, 1, None), (1, None, "z", DAY, 3, 1, None), (2, "b", "w", None, 4, 1, None)]
    card = {r.fy_key: (r.seen, r.missing) for r in completeness.month_completeness(spark.createDataFrame(rows, CHAIN)).collect()}
    assert card == {"2019-20": (1, 3), "2020-21": (0, 12), "2021-22": (0, 12), "2022-23": (0, 12), "2023-24": (1, 0)}


DECISIONS = "owner_id long, txn_id string, prediction_id string, category string, decided_at timestamp"
CORRECTIONS = "owner_id long, txn_id string, feedback_id string, category string, created_at timestamp"


def test_outcomes_against_a_loop(spark):
    rng = random.Random(8)
    at = lambda: rng.choice([None, *[datetime.datetime(2024, 1, 1, h) for h in range(24)]])
    key = lambda: (rng.choice([1, 2, None]), rng.choice(["hot", "hot", "hot", "t1", "t2", None]))
    made = [(*key(), f"p{i}", rng.choice("abc"), at()) for i in range(300)]
    told = [(*key(), f"f{i:03}", rng.choice(["a", "b", "c", None]), at()) for i in range(300)]
    told += told[:40]  # repeated rows
    found = completeness.accepted_outcomes(spark.createDataFrame(made, DECISIONS), spark.createDataFrame(told, CORRECTIONS), slices=7).collect()
    want = []
    for d in made:
        later = sorted(((c[4], c[2], c[3]) for c in told if c[:2] == d[:2] and c[4] and d[4] and c[4] > d[4]), key=lambda c: c[:2])
        want.append((*d, *((later[0][1], later[0][2], later[0][0], "confirmed" if later[0][2] == d[3] else "corrected") if later else (None, None, None, "untouched"))))
    assert Counter(map(tuple, found)) == Counter(want)


def test_no_rows(spark):
    empty = spark.createDataFrame([], CHAIN)
    assert completeness.balance_chain(empty).isEmpty() and completeness.month_completeness(empty).isEmpty()
    made, told = spark.createDataFrame([(1, "t", "p", "a", None)], DECISIONS), spark.createDataFrame([], CORRECTIONS)
    assert [r.outcome for r in completeness.accepted_outcomes(made, told).collect()] == ["untouched"]
    assert completeness.accepted_outcomes(made.limit(0), told).isEmpty()


def test_closure_reconciles_with_the_links(spark):
    linked = integrity_queries.linked_legs(spark, SF_DIR).cache()
    report = completeness.transfer_closure(linked).collect()
    links = transfers.links_of(linked).count()
    assert links > 0 and sum(r.linked_legs for r in report) == 2 * links
    assert all(r.balanced for r in report) and completeness.link_violations(linked).isEmpty()
    suspected = linked.filter("suspected").count()
    assert suspected == sum(r.suspected_waiting + r.suspected_open + r.suspected_overdue for r in report) > 0


def test_violations(spark):
    d = lambda n: DAY + datetime.timedelta(days=n)
    rows = [
        (1, "a", -5, d(0), "b"), (1, "b", 5, d(0), "a"), (1, "c", -5, d(0), "x"), (1, "e", -5, d(0), "f"), (1, "f", 6, d(1), "e"),
        (1, "g", -5, d(0), "h"), (1, "h", 5, d(30), "g"), (1, "i", -5, d(0), "j"), (1, "j", 5, d(0), "i"), (1, "k", -5, d(0), "j"), (1, "l", 5, d(0), None),
    ]
    frame = spark.createDataFrame(rows, "owner_id long, txn_id string, amount long, txn_date date, other_txn_id string")
    got = {(r.debit_txn_id, r.violation) for r in completeness.link_violations(frame).collect()}
    assert got == {("c", "one leg only"), ("e", "amounts differ"), ("g", "too far apart"), ("k", "one leg only"), ("k", "leg in two links"), ("i", "leg in two links")}


def test_registered_breaks_match_a_loop(spark):
    rows = [tuple(r) for r in q.captured_rows(spark, SF_DIR).select("owner_id", "own_account_id", "txn_id", "txn_date", "seq", "amount", "balance").collect()]
    got = {r.txn_id: (r.expected_balance, r.difference) for r in q.balance_breaks(spark, SF_DIR).collect()}
    assert got == serial_breaks(rows) and got
