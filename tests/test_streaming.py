"""A folder stream ingested in two batches, then the same folder again."""

import datetime

from pyspark.sql import functions as F

from ledgerloom.operators import rules
from ledgerloom.streaming import incremental

LEDGER = (
    incremental.LANDED
    + ", flow string, category string, subcategory string, merchant string, confidence string, reason string, signal string, "
    "layer int, review_required boolean, is_internal_transfer boolean, is_recurring boolean, project_id string, tax_section string, "
    "suspected_transfer boolean, source string, accepted_prediction_id string, counterparty_id string, counterparty_kind string, batch int"
)


def landed(txn, doc, text, amount, day, seq, parse=None):
    date = None if day is None else datetime.date(2024, 4, day)
    return (1, txn, doc, "a", "bank", "i", date, amount, "INR", text, None, seq, "2024-25", parse)


def knowledge():
    registry = "owner_id bigint, entries array<struct<id:string,kind:string,is_own_money:boolean,vpa_fragments:array<string>,name_tokens:array<string>,last4:array<string>>>"
    return incremental.Knowledge(
        profiles=lambda s: s.createDataFrame([], rules.PROFILE_SCHEMA),
        overrides=lambda s: s.createDataFrame([], "owner_id bigint, match_signature string, seq int, flow string, category string, subcategory string, merchant string, tax_section string, note string"),
        aliases=lambda s: s.createDataFrame([("plum", "Plum", "expenses.food", None, "user", "high", 1)], "pattern string, canonical_merchant string, category string, subcategory string, source string, confidence string, seq int"),
        counterparties=lambda s: s.createDataFrame([], registry),
    )


def test_two_batches_and_a_rerun(spark, tmp_path):
    landing, folder = str(tmp_path / "landing"), str(tmp_path / "out")
    schema = spark.createDataFrame([], LEDGER).schema
    first = [landed("t1", "d1", "plum cafe", -100, 1, 1), landed("t2", "d1", "plum cafe", -100, 1, 2)]
    second = [landed("t3", "d2", "plum cafe", -100, 1, 3), landed("t4", "d2", "unknown shop", -200, 2, 4)]
    for rows in (first, second):
        spark.createDataFrame(rows, incremental.LANDED).coalesce(1).write.mode("append").parquet(landing)
        incremental.start(spark, landing, folder, schema, knowledge()).awaitTermination()
    incremental.start(spark, landing, folder, schema, knowledge()).awaitTermination()
    stored = spark.read.schema(schema).parquet(f"{folder}/ledger")
    got = {r.txn_id: (r.category, r.layer, r.batch) for r in stored.collect()}
    # t3 repeats a stored key from another document; the two equal rows of d1 are both real
    assert got == {"t1": ("Food", 4, 0), "t2": ("Food", 4, 0), "t4": ("Uncategorised", 7, 1)}
    # a retried batch replaces its own partition
    write = incremental.batch_writer(folder, schema, knowledge())
    write(spark.createDataFrame(second, incremental.LANDED), 1)
    assert {r.txn_id for r in spark.read.schema(schema).parquet(f"{folder}/ledger").collect()} == set(got)
    items = spark.createDataFrame([], "item_id string, owner_id bigint, kind string, ref_id string, title string, detail string, severity string, status string")
    tables = incremental.project(incremental.stored_ledger(spark, folder, schema), items)
    assert [r.ref_id for r in tables["review_items"].collect()] == ["t4"]
    assert tables["ledger"].count() == 3


def run_batches(spark, folder, *batches):
    """Current rows after the batches, each written as the stream would."""
    schema = spark.createDataFrame([], LEDGER).schema
    write = incremental.batch_writer(folder, schema, knowledge())
    for number, rows in enumerate(batches):
        write(spark.createDataFrame(rows, incremental.LANDED), number)
    return {r.txn_id for r in incremental.current_rows(incremental.stored_ledger(spark, folder, schema)).collect()}


def test_a_document_in_two_files(spark, tmp_path):
    first = [landed("t1", "d1", "plum cafe", -100, 1, 1, 1), landed("t9", "d2", "other", -5, 2, 2, 1)]
    second = [landed("t2", "d1", "plum cafe", -100, 1, 3, 1), landed("t8", "d3", "plum cafe", -100, 1, 4, 1)]
    # t2 equals t1 of the same document and is real; t8 repeats it from another one
    assert run_batches(spark, str(tmp_path), first, second) == {"t1", "t2", "t9"}


def test_superseded_rows_claim_nothing(spark, tmp_path):
    first = [landed("t1", "d1", "plum cafe", -100, 1, 1, 1)]
    again = [landed("t2", "d1", "unknown shop", -7, 1, 2, 2)]
    later = [landed("t3", "d9", "plum cafe", -100, 1, 3, 1), landed("t0", "d1", "late old parse", -1, 1, 4, 1)]
    assert run_batches(spark, str(tmp_path), first, again, later) == {"t2", "t3"}


def test_an_empty_parse_removes_the_rows(spark, tmp_path):
    first = [landed("t1", "d1", "plum cafe", -100, 1, 1, 1), landed("t2", "d2", "x shop", -3, 1, 2, 1)]
    empty = [landed(None, "d1", None, None, None, None, 2)]
    assert run_batches(spark, str(tmp_path), first, empty) == {"t2"}


def test_null_keys_are_kept_once(spark, tmp_path):
    rows = [landed("t1", "d1", "plum cafe", -100, None, 1, 1), landed("t2", "d2", "plum cafe", -100, None, 2, 1), landed("t3", None, "x", None, 1, 3, 1)]
    assert run_batches(spark, str(tmp_path), rows) == {"t1", "t3"}


def test_the_whole_write_path(spark, tmp_path):
    """Accounts of documents, the label model, own names, duplicate candidates; a rerun of the batch changes nothing."""
    row = landed("t1", "d1", "unseen thing", -100, 1, 1, 1)
    rows = [
        row, landed("t2", "d1", "sent to asha verma", -500, 2, 2, 1), landed("t3", "d2", "unseen thing north", -100, 1, 3, 1),
        landed("t4", "d1", "plum cafe", -70, 3, 4, 1), landed("t5", "d1", "no vector here", -9, 3, 5, 1),
        landed("t6", "d3", "asha verma own money", 500, 2, 6, 1),
    ]
    base = knowledge()
    example = lambda i, category, v: (1, f"e{i}", f"M{category}", "expense", category, None, None, v, "m")
    vectors = "owner_id bigint, txn_id string, embedding array<double>"
    model = incremental.LabelModel(
        vectors=lambda s: s.createDataFrame([(1, t, [1.0, 0.01]) for t in ("t1", "t2", "t3", "t4")], vectors),
        examples=lambda s: s.createDataFrame(
            [example(i, "Groceries", [1.0, 0.0]) for i in range(3)] + [example(i + 3, "Fuel", [0.0, 1.0]) for i in range(3)],
            "owner_id bigint, example_id string, merchant string, flow string, category string, subcategory string, institution_id string, embedding array<double>, embedding_model_id string",
        ),
        dimensions=2, model_id="m",
    )
    whole = incremental.Knowledge(
        base.profiles, base.overrides, base.aliases, base.counterparties,
        documents=lambda s: s.createDataFrame([(1, d, n, "i", "1234", "bank_statement", 1) for n, d in enumerate(("d1", "d2"))], "owner_id bigint, document_id string, seq bigint, institution_id string, account_last4 string, doc_type string, txn_count bigint"),
        accounts=lambda s: s.createDataFrame([(1, "acc_main", "bank", "i", "1234", None)], "owner_id bigint, account_id string, kind string, institution_id string, last4 string, nickname string"),
        own_names=lambda s: s.createDataFrame([(1, ["asha verma"])], "owner_id bigint, names array<string>"),
        label_model=model,
    )
    schema = spark.createDataFrame([], LEDGER).schema
    folder = str(tmp_path)
    write = incremental.batch_writer(folder, schema, whole)
    batch = spark.createDataFrame(rows, incremental.LANDED)
    write(batch, 0)
    read = lambda: {r.txn_id: r for r in incremental.stored_ledger(spark, folder, schema).collect()}
    got = read()
    # d3 is not known as a document: its row keeps the account it came with
    assert {t: r.own_account_id for t, r in got.items()} == {**dict.fromkeys(("t1", "t2", "t3", "t4", "t5"), "acc_main"), "t6": "a"}
    assert (got["t1"].category, got["t1"].source, got["t1"].layer, got["t1"].review_required) == ("Groceries", "local_ml", 10, False)
    assert got["t1"].accepted_prediction_id and got["t1"].merchant == "MGroceries"
    assert got["t2"].is_internal_transfer and got["t6"].is_internal_transfer and got["t2"].accepted_prediction_id is None
    # a strong verdict is not scored, a row without a vector keeps its own
    assert (got["t4"].category, got["t4"].layer) == ("Food", 4) and (got["t5"].category, got["t5"].source) == ("Uncategorised", "deterministic")
    write(batch, 0)
    assert read() == got
    items = spark.createDataFrame([], "item_id string, owner_id bigint, kind string, ref_id string, title string, detail string, severity string, status string")
    tables = incremental.project(incremental.stored_ledger(spark, folder, schema), items)
    assert [(r.keeper_txn_id, r.candidate_txn_id, r.status) for r in tables["duplicates"].collect()] == [("t1", "t3", "open")]
    kept = tables["duplicates"].withColumn("status", F.lit("kept"))
    assert [r.status for r in incremental.project(incremental.stored_ledger(spark, folder, schema), items, decisions=kept)["duplicates"].collect()] == ["kept"]
