"""Stored tables: only touched places are read and rewritten, and results equal those of the whole-table operators."""

import datetime
import glob
import os

import pytest

from ledgerloom.operators import accounts, partitions, tables
from ledgerloom.streaming import incremental
from tests.test_streaming import LEDGER, knowledge, landed

ROWS = "owner_id long, txn_id string, document_id string, txn_date date, amount long, category string"


def row(owner, txn, doc, year, amount=1, category="a"):
    return (owner, txn, doc, None if year is None else datetime.date(year, 5, 1), amount, category)


def files(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/*/*/*.parquet")}


def spoil(file):
    """Makes the rows of a Parquet file unreadable; its footer, which any reader may look at for the schema, stays."""
    held = open(file, "rb").read()
    open(file, "wb").write(held[:4] + bytes(40) + held[44:])
    crc = os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc")
    if os.path.exists(crc):
        os.remove(crc)


def place(spark, owner, year):
    frame = partitions.placed(spark.createDataFrame([row(owner, "x", "d", year)], ROWS))
    return "/".join(f"{n}={v}" for n, v in zip(partitions.PLACE, partitions.touched(frame)[0], strict=True))


def stored(spark, folder, rows):
    partitions.write_new(spark.createDataFrame(rows, ROWS), folder)
    return lambda: sorted((tuple(r) for r in partitions.read(spark, folder).select("owner_id", "txn_id", "document_id", "txn_date", "amount", "category").collect()), key=repr)


START = [row(1, "t1", "d1", 2020), row(1, "t2", "d1", 2021), row(2, "t3", "d2", 2020), row(3, "t4", "d3", None), row(2, "t5", "d4", 2021)]


def test_upsert_leaves_other_files_alone(spark, tmp_path):
    folder = str(tmp_path / "t")
    read = stored(spark, folder, START)
    before = files(folder)
    fresh = spark.createDataFrame([row(1, "t1", "d1", 2020, 9, "new"), row(1, "t9", "d9", 2020, 7, "b"), row(3, "t4", "d3", None, 5, "c"), row(4, "t10", "d", 2022)], ROWS)
    done = partitions.upsert_stored(folder, fresh, ["owner_id", "txn_id"], ["category"])
    assert len(done) == 3
    want = tables.upsert(spark.createDataFrame(START, ROWS), fresh, ["owner_id", "txn_id"], ["category"])
    assert read() == sorted((tuple(r) for r in want.select(*[c.split(" ")[0] for c in ROWS.split(", ")]).collect()), key=repr)
    after = files(folder)
    untouched = {f for f in before if place(spark, 1, 2020) not in f and place(spark, 3, None) not in f}
    assert len(untouched) == 3 and all(after.get(f) == before[f] for f in untouched)
    assert all(f not in after for f in before if f not in untouched)
    assert partitions.upsert_stored(folder, fresh.limit(0), ["owner_id", "txn_id"], ["category"]) == [] and files(folder) == after


def test_replace_finds_old_rows_in_other_years_and_drops_empty_places(spark, tmp_path):
    folder = str(tmp_path / "t")
    read = stored(spark, folder, START)
    before = files(folder)
    fresh = spark.createDataFrame([row(1, "n1", "d1", 2021, 4)], ROWS)
    gone = spark.createDataFrame([(1, "d1"), (2, "d4"), (7, "none")], "owner_id long, document_id string")
    partitions.replace_documents_stored(folder, fresh, gone)
    assert read() == sorted([row(1, "n1", "d1", 2021, 4), START[2], START[3]], key=repr)
    assert not os.path.exists(f"{folder}/{place(spark, 1, 2020)}") and not os.path.exists(f"{folder}/{place(spark, 2, 2021)}")
    kept = [f for f in before if place(spark, 2, 2020) in f or place(spark, 3, None) in f]
    assert len(kept) == 2 and all(files(folder)[f] == before[f] for f in kept)
    assert partitions.replace_documents_stored(folder, fresh.limit(0), gone.filter("owner_id = 7")) == []


def test_only_touched_directories_are_read(spark, tmp_path):
    folder = str(tmp_path / "t")
    stored(spark, folder, START)
    for f in files(folder):
        if place(spark, 1, 2020) not in f:
            spoil(f)
    with pytest.raises(Exception, match="(?i)parquet|read|decode"):
        partitions.read(spark, folder).collect()
    partitions.upsert_stored(folder, spark.createDataFrame([row(1, "t1", "d1", 2020, 1, "z")], ROWS), ["owner_id", "txn_id"], ["category"])
    only = partitions.read(spark, folder).filter(partitions.within(partitions.touched(partitions.placed(spark.createDataFrame([START[0]], ROWS)))))
    assert [r.category for r in only.collect()] == ["z"]


def test_within(spark):
    frame = spark.createDataFrame([(b, y) for b in range(4) for y in range(3)], "owner_bucket int, place_year int")
    asked = [(0, 1), (2, 1), (3, 2)]
    assert sorted(tuple(r) for r in frame.filter(partitions.within(asked)).collect()) == asked
    assert frame.filter(partitions.within([])).isEmpty()
    assert frame.filter(partitions.within([(1,), (3,)], ["owner_bucket"])).count() == 6


def test_a_batch_reads_only_its_owners_and_years(spark, tmp_path):
    """The ledger files of other owners and years are made unreadable: a batch that does not touch them still runs."""
    folder = str(tmp_path)
    schema = spark.createDataFrame([], LEDGER).schema
    write = incremental.batch_writer(folder, schema, knowledge())

    def late(txn, doc, text, amount, year, seq, parse=1):
        made = list(landed(txn, doc, text, amount, 1, seq, parse))
        made[6] = datetime.date(year, 4, 1)
        return tuple(made)

    def batch(*rows, owner=1):
        return spark.createDataFrame([(owner, *r[1:]) for r in rows], incremental.LANDED)

    write(batch(late("t1", "d1", "plum cafe", -100, 2024, 1), late("t2", "d1", "plum cafe", -100, 2023, 2)), 0)
    write(batch(late("t3", "d5", "plum cafe", -100, 2024, 3), owner=2), 1)
    history = [f for f in glob.glob(f"{folder}/ledger/*/*/*/*.parquet") if "place_year=2024" not in f or "batch=1" in f]
    assert len(history) == 2
    for f in history:
        spoil(f)
    # d2 repeats t1; d1 is parsed again, which only the parses table tells for its row of 2024
    write(batch(late("t4", "d2", "plum cafe", -100, 2024, 4)), 2)
    write(batch(late("t5", "d1", "other shop", -5, 2022, 5, 2)), 3)
    write(batch(late("t6", "d7", "plum cafe", -100, 2024, 6)), 4)
    got = set()
    for path in glob.glob(f"{folder}/ledger/batch=*/*/*/*.parquet"):
        if path not in history:
            got |= {r.txn_id for r in spark.read.parquet(path).collect()}
    # t4 was a duplicate of t1; once d1's rows are superseded, t6 is claimed by nothing
    assert got == {"t1", "t5", "t6"}


def test_stubs_are_added_once(spark):
    known = spark.createDataFrame([(1, "acc_1", "bank", "i", "1234", "main")], "owner_id long, account_id string, kind string, institution_id string, last4 string, nickname string")
    docs = spark.createDataFrame(
        [(1, f"d{n}", n, "j", "9999", "bank_statement", 2) for n in range(3)] + [(1, "d9", 9, "i", "1234", "bank_statement", 2)],
        "owner_id long, document_id string, seq long, institution_id string, account_last4 string, doc_type string, txn_count long",
    )
    after = accounts.with_stubs(known, accounts.resolve_accounts(docs, known))
    assert after.count() == 2 and after.filter("last4 = '9999' and institution_id = 'j'").count() == 1
    assert accounts.with_stubs(after, accounts.resolve_accounts(docs, after)).count() == 2
    assert accounts.with_stubs(after, accounts.resolve_accounts(docs, known)).count() == 2


@pytest.mark.parametrize("still, unlocked", [(0, 2), (1, 1), (3, 0)])
def test_requeue_counts(spark, still, unlocked):
    items = "owner_id long, kind string"
    before = spark.createDataFrame([(1, "locked_pdf"), (1, "locked_pdf"), (1, "uncategorised")], items)
    after = spark.createDataFrame([(1, "locked_pdf")] * still + [(1, "other")], items)
    assert [tuple(r) for r in tables.requeue_result(before, after).collect()] == [(1, 2, still, unlocked)]
