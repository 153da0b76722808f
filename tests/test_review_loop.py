"""A batch of assignments and its undo over every table they touch."""

from pyspark.sql import functions as F

from ledgerloom.operators import review

LEDGER = (
    "owner_id bigint, txn_id string, raw_description string, amount bigint, institution_id string, merchant string, category string, subcategory string, "
    "flow string, is_internal_transfer boolean, suspected_transfer boolean, confidence string, layer int, source string, "
    "accepted_prediction_id string, reason string, signal string, review_required boolean"
)


def pending(owner, txn, text, amount=-100):
    return (owner, txn, text, amount, None, None, "Uncategorised", None, "expense", False, False, "low", 7, "deterministic", None, "no rule", None, True)


def state(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    return {
        "transactions": spark.createDataFrame(
            [pending(1, "t1", "upi/plum cafe/1"), pending(1, "t2", "plum cafe 22"), pending(1, "t3", "plum garden shop"), pending(1, "t4", None), pending(2, "t1", "plum cafe")],
            LEDGER,
        ),
        "overrides": spark.createDataFrame([(1, "plum cafe", "Before", "gift", None, None), (1, "other", "X", "rent", None, None)], "owner_id bigint, match_signature string, merchant string, category string, subcategory string, flow string"),
        "aliases": none("owner_id bigint, alias_id string, pattern string, canonical_merchant string, category string, subcategory string, source string, confidence string"),
        "feedback": none("owner_id bigint, feedback_id string, txn_id string, merchant string, category string"),
        "examples": spark.createDataFrame([(1, "ex_review_assignment_t2", "t2", "Old", "gift", [1.0])], "owner_id bigint, example_id string, txn_id string, merchant string, category string, embedding array<double>"),
        "review_items": spark.createDataFrame([(1, "i1", "t1", "open"), (1, "i3", "t3", "open"), (1, "i4", "t4", "open"), (2, "i1", "t1", "open")], "owner_id bigint, item_id string, ref_id string, status string"),
        "heads": spark.createDataFrame([(1, False), (2, False)], "owner_id bigint, stale boolean"),
        "images": none("owner_id bigint, operation_id string, table_name string, row_key string, existed boolean, prior string"),
        "journal": none("owner_id bigint, operation_id string, created_at timestamp, consumed_at timestamp"),
    }


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_two_assignments_and_their_undo(spark):
    first = state(spark)
    choice = "owner_id bigint, seq bigint, signature string, merchant string, category string, subcategory string"
    one = spark.createDataFrame([(1, 1, "plum cafe", "Plum House", "Dining", None)], choice)
    at = lambda day: F.lit(f"2024-01-0{day}").cast("timestamp")
    second = review.assign(first, one, F.lit("op1"), at(1))
    changed = {r.txn_id: (r.merchant, r.category, r.layer, r.review_required) for r in second["transactions"].filter("owner_id = 1").collect()}
    assert changed["t1"] == changed["t2"] == ("Plum House", "dining", 1, False)
    assert changed["t3"] == ("Plum House", "dining", 4, False) and changed["t4"][3]
    assert rows(second["overrides"].select("match_signature", "merchant", "category")) == [("other", "X", "rent"), ("plum cafe", "Plum House", "dining")]
    assert rows(second["aliases"].select("alias_id", "category")) == [("ua_plum", "dining")]
    # the swept row is no label; a new example has no vector until it is embedded
    assert rows(second["feedback"].select("txn_id", "category")) == [("t1", "Dining"), ("t2", "Dining")]
    assert rows(second["examples"].select("txn_id", "merchant", "embedding")) == [("t1", "Plum House", None), ("t2", "Plum House", None)]
    assert rows(second["review_items"].select("owner_id", "item_id", "status")) == [(1, "i1", "resolved"), (1, "i3", "resolved"), (1, "i4", "open"), (2, "i1", "open")]
    assert rows(second["heads"]) == [(1, True), (2, False)]

    two = spark.createDataFrame([(2, 1, "plum cafe", "", "Travel", None)], choice)
    third = review.assign(second, two, F.lit("op2"), at(2))
    undone = review.undo(third, at(3))
    # each owner's newest operation goes back: here that is everything
    for name in review.JOURNALLED_KEYS:
        assert rows(undone[name].select(*first[name].columns)) == rows(first[name]), name
    assert undone["journal"].filter("consumed_at is null").isEmpty() and undone["journal"].count() == 2
    assert rows(undone["heads"]) == [(1, True), (2, True)]
    again = review.undo(undone, at(4))
    assert rows(again["transactions"]) == rows(undone["transactions"])
    assert rows(again["journal"]) == rows(undone["journal"])
