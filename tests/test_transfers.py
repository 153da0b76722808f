"""Run-based pairing against a plain serial greedy loop."""

import datetime
import random

import pytest

from ledgerloom.operators import transfers

COLUMNS = (
    "owner_id bigint, txn_id string, document_id string, own_account_id string, txn_date date, amount bigint, "
    "raw_description string, merchant string, flow string, counterparty_kind string"
)


def leg(txn_id, amount, day, text="shop", doc="d", account=None, merchant=None, flow=None, kind=None, owner=1):
    return (owner, txn_id, doc, account, datetime.date(2024, 1, 1) + datetime.timedelta(days=day), amount, text, merchant, flow, kind)


def random_legs(rng, count, owners=2, amounts=3, days=30):
    rows = []
    for i in range(count):
        rows.append(
            leg(
                f"t{i:04d}", rng.choice([-1, 1]) * rng.randint(1, amounts) * 100, rng.randint(0, days),
                rng.choice(["self transfer", "shop"]), rng.choice(["d1", "d2", "d3", None]), rng.choice(["a1", "a2", "a3", None]),
                rng.choice([None, None, "Shop"]), owner=rng.randint(1, owners),
            )
        )
    return rows


def serial(rows):
    """Each debit in order takes the first unused compatible credit."""

    def view(r):
        owner, txn, doc, account, date, amount, text, merchant, _, _ = r
        explicit = "self" in text
        return dict(owner=owner, id=txn, doc=doc or "", account=account or "", date=date, amount=amount, explicit=explicit,
                    bare=bool(account) and not merchant)

    legs = sorted((view(r) for r in rows), key=lambda v: (v["date"], v["doc"], v["account"], v["explicit"], v["bare"], v["id"]))
    used, pairs = set(), set()
    for d in (v for v in legs if v["amount"] < 0):
        for c in (v for v in legs if v["amount"] > 0):
            if c["id"] in used or c["owner"] != d["owner"] or c["amount"] != -d["amount"]:
                continue
            if abs((c["date"] - d["date"]).days) > 4 or (d["doc"] and d["doc"] == c["doc"]):
                continue
            if not ((d["explicit"] and c["explicit"]) or (d["bare"] and c["bare"] and d["account"] != c["account"])):
                continue
            used.add(c["id"])
            pairs.add((d["id"], c["id"]))
            break
    return pairs


def paired(spark, rows, **options):
    flagged = transfers.with_flags(spark.createDataFrame(rows, COLUMNS))
    found = transfers.transfer_pairs(flagged, **options).collect()
    return {(r.debit_txn_id, r.credit_txn_id) for r in found}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_serial_greedy(spark, seed):
    rows = random_legs(random.Random(seed), 400)
    expected = serial(rows)
    assert len(expected) > 50
    assert paired(spark, rows) == expected


def test_blocks_of_one_piece_equal_serial_greedy(spark):
    """A dense piece cut into small blocks gives the same pairs as one task would."""
    rows = random_legs(random.Random(3), 120, owners=1, amounts=1, days=6)
    assert paired(spark, rows, max_runs=25) == serial(rows)


def test_long_piece_in_small_blocks_equals_serial_greedy(spark):
    """Blocks that lie further apart than the window never meet, and the pairs stay those of the serial loop."""
    rows = random_legs(random.Random(4), 110, owners=1, amounts=1, days=45)
    expected = serial(rows)
    assert len(expected) > 10
    assert paired(spark, rows, max_runs=12) == expected


def test_only_blocks_within_the_window_meet(spark):
    extent = [(1, 100, 0, side, block, 10 * block, 10 * block + 9) for side in ("debit", "credit") for block in range(50)]
    columns = "owner_id bigint, abs_amount bigint, piece bigint, side string, block bigint, first_day int, last_day int"
    met = transfers._meetings(spark.createDataFrame(extent, columns), 4).collect()
    assert {(r.d_block, r.c_block) for r in met} == {(i, j) for i in range(50) for j in range(50) if abs(i - j) <= 1}


def test_large_run_is_ranked_in_slices(spark):
    debits = [leg(f"d{i:03d}", -100, 0, "self", "one") for i in range(60)]
    credits = [leg(f"c{i:03d}", 100, 1, "self", "two") for i in range(45)]
    pairs = paired(spark, debits + credits, group_bound=10)
    assert pairs == {(f"d{i:03d}", f"c{i:03d}") for i in range(45)}


def linked(spark, rows):
    return {r.txn_id: r for r in transfers.link_transfers(spark.createDataFrame(rows, COLUMNS)).collect()}


def test_single_sided_and_suspected(spark):
    rows = [
        leg("bill", -500, 0, "CC payment for may"),
        leg("mandate", -500, 0, "UPI AUTOPAY stream service", account="a"),
        leg("card", -500, 0, "autopay towards my card"),
        leg("got", 700, 0, "payment received thanks"),
        leg("own", -900, 0, "to savings", kind="known_own"),
        leg("round", 20_000_000, 0, "big one"),
        leg("round_shop", 20_000_000, 0, "big one", merchant="Shop"),
        leg("odd", 20_000_100, 0, "big one"),
        leg("external", 20_000_000, 0, "big one", kind="external"),
    ]
    got = linked(spark, rows)
    assert {k for k, r in got.items() if r.is_transfer} == {"bill", "card", "got", "own"}
    assert {k for k, r in got.items() if r.suspected} == {"round"}


def test_same_document_never_pairs_and_card_kind(spark):
    rows = [
        leg("a", -100, 0, "neft out", "x"), leg("b", 100, 1, "neft in", "x"),
        leg("c", -200, 0, "card payment", "x"), leg("d", 200, 3, "payment received", "y"),
        leg("e", -300, 0, "rent", "x", "a1"), leg("f", 300, 5, "salary", "y", "a2"),
    ]
    frame = transfers.link_transfers(spark.createDataFrame(rows, COLUMNS))
    links = [(r.debit_txn_id, r.credit_txn_id, r.kind) for r in transfers.links_of(frame).collect()]
    assert links == [("c", "d", "cc_payment")]
