"""Duplicates, recurrence, accounts, labels and journals on small fixtures."""

import datetime
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.operators import accounts, dedup, labels, quality, recurrence, review, rules, tables

ROWS = "owner_id bigint, txn_id string, document_id string, own_account_id string, txn_date date, amount bigint, raw_description string, seq bigint"
DAY = datetime.date(2024, 1, 1)


def row(txn_id, doc, text="tea stall", seq=0, account="a", amount=-100, day=DAY, owner=1):
    return (owner, txn_id, doc, account, day, amount, text, seq)


def ids(df, column="txn_id"):
    return {r[column] for r in df.collect()}


def test_only_other_documents_make_a_duplicate(spark):
    incoming = spark.createDataFrame(
        [row("1", "x", seq=1), row("2", "x", seq=2), row("3", "y", seq=3), row("4", "y", "book shop", 4), row("5", "y", seq=5, owner=2)], ROWS
    )
    none = incoming.limit(0)
    kept = dedup.mark_duplicates(incoming, none).filter("kept")
    assert ids(kept) == {"1", "2", "4", "5"}
    again = dedup.mark_duplicates(incoming, kept.select(*incoming.columns)).filter("kept")
    assert ids(again) == set()
    assert ids(dedup.historical_excess(incoming)) == {"3"}
    assert dedup.historical_excess(kept.select(*incoming.columns)).isEmpty()


def test_prefix_drift_against_brute_force(spark):
    rng = random.Random(5)
    words = ["tea", "tea stall", "tea stall north", "tea house", "book", ""]
    rows = [
        row(f"t{i:03d}", rng.choice(["x", "y", "z", None]), rng.choice(words), rng.randint(0, 50), rng.choice(["a", "b", None]), rng.choice([-1, -2]))
        for i in range(200)
    ]
    stored, incoming = rows[:80], rows[80:]
    got = {
        (r.candidate_txn_id, r.keeper_txn_id)
        for r in dedup.suspected_pairs(spark.createDataFrame(stored, ROWS), spark.createDataFrame(incoming, ROWS)).collect()
    }
    order = sorted([(0, r[7], r[1], r) for r in stored] + [(1, r[7], r[1], r) for r in incoming])
    expected = set()
    for i, (phase, _, _, c) in enumerate(order):
        if phase == 0:
            continue
        for _, _, _, p in order[:i]:
            same = p[2] and c[2] and p[2] != c[2] and p[3] and p[3] == c[3] and p[5] == c[5]
            prefix = p[6] and c[6] and (p[6].startswith(c[6] + " ") or c[6].startswith(p[6] + " "))
            if same and prefix:
                expected.add((c[1], p[1]))
                break
    assert len(expected) > 20
    assert got == expected


def test_only_places_that_may_hold_a_pair_are_probed(spark):
    """Rows of one document or of one signature at their place never go to the lookups; nulls and repeated rows as ever."""
    alone = [row(f"a{i}", "x", "tea stall", i, amount=-10 - i) for i in range(20)]
    same = [row(f"s{i}", d, "tea stall", i, amount=-5) for i, d in enumerate(["x", "y", "z"])]
    pair = [row("p1", "x", "tea", 1), row("p2", "y", "tea stall", 2), row("p2", "y", "tea stall", 2), row("p3", "y", "tea stall", 3)]
    void = [(None, *r[1:]) for r in pair[:2]] + [row("n1", None, "tea", 0), row("n2", "y", "", 0)]
    rows = spark.createDataFrame(alone + same + pair + void, ROWS)
    found = dedup.suspected_pairs(rows.limit(0), rows)
    assert sorted((r.candidate_txn_id, r.keeper_txn_id) for r in found.collect()) == [("p2", "p1"), ("p3", "p1")]
    probed = spark.read.parquet(*found.inputFiles()).select("position.txn_id")
    assert sorted(r.txn_id for r in probed.collect()) == ["p1", "p2", "p2", "p3"]


def charge(i, day, amount=-50_000, text="Songs app", **extra):
    return (1, f"t{i:03d}", DAY + datetime.timedelta(days=day), amount, text, extra.get("merchant"), extra.get("category", "Subscriptions"), extra.get("layer", 6), "expense", False)


CHARGES = "owner_id bigint, txn_id string, txn_date date, amount bigint, raw_description string, merchant string, category string, layer int, flow string, is_internal_transfer boolean"


def test_recurrence_bands_and_guards(spark):
    rows = [charge(i, 30 * i) for i in range(4)]
    rows += [charge(10 + i, 30 * i, text="ACH mandate corp") for i in range(4)]
    rows += [charge(20 + i, 30 * i, -3_000_000, "Big plan") for i in range(4)]
    rows += [charge(30 + i, 10 * i, text="Too often") for i in range(4)]
    rows += [charge(40 + i, d, text="Twice a day") for i, d in enumerate([0, 0, 30, 60, 90])]
    found = {r.signature: (r.cadence, r.occurrences) for r in recurrence.recurrence_index(spark.createDataFrame(rows, CHARGES)).collect()}
    assert found == {"songs app": ("monthly", 4), "twice a day": ("monthly", 5)}


def test_subscriptions(spark):
    rows = [charge(1, 0, -150_000, merchant="Films", category="Ott", layer=4), charge(2, 0, -20_000, merchant="Music+", category="Music", layer=4)]
    rows += [charge(10 + i, 90 * i, -7_000 - i, "12:30 Quarterly club") for i in range(3)]
    rows += [charge(20 + i, 30 * i, -2_000, "Tiny fee app") for i in range(3)]
    rows += [charge(30 + i, 30 * i, -9_000, "x9") for i in range(3)] + [charge(40, 0, category="Housing")]
    ledger = spark.createDataFrame(rows, CHARGES)
    previous = spark.createDataFrame([(1, "sub_m-films", "dismissed")], "owner_id bigint, subscription_id string, status string")
    got = {r.subscription_id: (r.merchant, r.cadence, r.status, r.amount) for r in recurrence.detect_subscriptions(ledger, previous).collect()}
    assert got == {
        "sub_m-films": ("Films", "yearly", "dismissed", 150_000), "sub_m-music": ("Music+", "monthly", "confirmed", 20_000),
        "sub_s-quarterly-club": ("Quarterly club", "quarterly", "likely", 7_002),
    }


def serial_resolve(docs, registered):
    """Documents in order; a minted account is visible to the following ones."""
    known = [dict(id=a, kind=k, inst=i, last4=n) for a, k, i, n in sorted(registered)]

    def family(x):
        return "" if x is None else x.removesuffix("-cards")

    out = {}
    for seq, doc, inst, last4, kind, count in sorted(docs):
        mine = [a for a in known if a["kind"] == kind and family(a["inst"]) == family(inst)]
        if last4:
            hit = next((a for a in mine if a["last4"] == last4), None)
            if hit:
                out[doc] = (hit["id"], "header_match")
            elif len(mine) == 1 and mine[0]["last4"] is None:
                out[doc] = (mine[0]["id"], "institution_unique")
            else:
                minted = f"new {kind} {family(inst)} {last4}"
                known.append(dict(id=minted, kind=kind, inst=inst, last4=last4))
                out[doc] = (minted, "stub")
        elif inst is not None and len(mine) == 1 and count > 0:
            out[doc] = (mine[0]["id"], "institution_unique")
        else:
            out[doc] = (None, None)
    return out


def test_account_policy_against_a_serial_loop(spark):
    rng = random.Random(11)
    registered = [(f"acc{i}", rng.choice(["bank", "card"]), rng.choice(["p", "q", "q-cards", "r", None]), rng.choice(["1111", "2222", None])) for i in range(5)]
    docs = [
        (i, f"d{i:03d}", rng.choice(["p", "p-cards", "q", "r", "s", None]), rng.choice(["1111", "3333", "4444", None, None]), rng.choice(["bank", "card"]), rng.choice([0, 3]))
        for i in range(150)
    ]
    frame = spark.createDataFrame(
        [(1, d, s, i, n, "card_statement" if k == "card" else "bank_statement", c) for s, d, i, n, k, c in docs],
        "owner_id bigint, document_id string, seq bigint, institution_id string, account_last4 string, doc_type string, txn_count bigint",
    )
    known = spark.createDataFrame([(1, *a) for a in registered], "owner_id bigint, account_id string, kind string, institution_id string, last4 string")
    resolved = accounts.resolve_accounts(frame, known).collect()
    names = {
        r.own_account_id: f"new {r.own_account_kind} {(r.institution_id or '').removesuffix('-cards')} {r.account_last4}"
        for r in resolved if r.account_source == "stub"
    }
    got = {r.document_id: (names.get(r.own_account_id, r.own_account_id), r.account_source) for r in resolved}
    assert got == serial_resolve(docs, registered)


def test_gates_and_decisions(spark):
    base = rules.verdict(F.lit(True), flow="expense", category="Uncategorised", confidence="low", layer=F.col("layer"), review_required=F.lit(True), tax_section=F.col("tax"))
    rows = [
        ("accept", -100, 7, None, "expense", "Groceries", 0.95, 0.8, 3, True), ("margin", -100, 7, None, "expense", "Groceries", 0.95, 0.6, 3, True),
        ("not_listed", -100, 7, None, "expense", "Odd", 0.99, 0.9, 9, True), ("weak", -100, 5, None, "expense", "Dining", 0.3, 0.1, 9, True),
        ("sign", 100, 7, None, "expense", "Dining", 0.99, 0.9, 9, True), ("strong_layer", -100, 4, None, "expense", "Dining", 0.99, 0.9, 9, True),
        ("taxed", -100, 7, "80C", "expense", "Dining", 0.99, 0.9, 9, True), ("no_example", -100, 7, None, "expense", "Dining", 0.99, 0.9, 0, False),
    ]
    df = spark.createDataFrame(
        rows, "txn_id string, amount bigint, layer int, tax string, predicted_flow string, predicted_category string, probability double, margin double, evidence bigint, any_compatible boolean"
    ).withColumns({"verdict": base, "predicted_subcategory": F.lit(None).cast("string"), "nearest_merchant": F.lit("Near")})
    got = {r.txn_id: (r.review_status, r.source, r.final.category) for r in labels.decide(df).collect()}
    assert got == {
        "accept": ("accepted", "local_ml", "Groceries"), "margin": ("suggested", "deterministic", "Uncategorised"),
        "not_listed": ("suggested", "deterministic", "Uncategorised"), "weak": ("required", "deterministic", "Uncategorised"),
        "sign": ("required", "deterministic", "Uncategorised"), "strong_layer": ("required", "deterministic", "Uncategorised"),
        "taxed": ("required", "deterministic", "Uncategorised"), "no_example": ("required", "deterministic", "Uncategorised"),
    }
    loose = {r.txn_id for r in labels.decide(df, 0, 0.0, 0.0, ["Odd", "Groceries"]).filter("source = 'local_ml'").collect()}
    assert loose == {"accept", "not_listed"}


def test_toy_head(spark):
    examples = spark.createDataFrame(
        [(1, f"g{i}", "Green", "expense", "Groceries", None, None, [1.0, 0.05 * i], "m") for i in range(3)]
        + [(1, f"r{i}", "Ride", "expense", "Transport", None, None, [0.05 * i, 1.0], "m") for i in range(3)]
        + [(1, "bad", "Bad", "expense", "Odd", None, None, [1.0], "m"), (1, "none", "None", "expense", "Groceries", None, None, None, "m")]
        + [(1, "far", "Far", "expense", "Foreign", None, None, [1.0, 0.0], "another")],
        "owner_id bigint, example_id string, merchant string, flow string, category string, subcategory string, institution_id string, embedding array<double>, embedding_model_id string",
    )
    rows = spark.createDataFrame([(1, "t", [2.0, 0.0], None, -100)], "owner_id bigint, txn_id string, embedding array<double>, institution_id string, amount bigint")
    found = labels.predict(rows, labels.train_head(examples, 2, "m"))
    assert {r.category for r in labels.train_head(examples, 2, "m").collect()} == {"Groceries", "Transport"}
    counted = labels.count_evidence(found, examples, "m", 2).first()
    assert counted.evidence == 3 and counted.any_compatible
    odd = spark.createDataFrame([(1, "short", [2.0], None, -1), (1, "null", None, None, -1), (2, "nohead", [1.0, 0.0], None, -1)], rows.schema)
    kept = labels.predict(odd, labels.train_head(examples, 2, "m")).collect()
    assert {(r.txn_id, r.label_id, r.probability) for r in kept} == {("short", None, None), ("null", None, None), ("nohead", None, None)}
    best = found.first()
    assert best.predicted_category == "Groceries" and best.probability > 0.9 and best.margin > 0.75
    nearest = labels.nearest_examples(found, examples, "m").orderBy("position").collect()
    assert [n.example_id for n in nearest] == ["g0", "g1", "g2"]
    assert labels.train_head(examples.limit(0), 2, "m").isEmpty()


def test_scores_equal_a_plain_loop_in_many_slices(spark, monkeypatch):
    """Repeated ids, vectors with a null and owners without a head come back once each."""
    rng = random.Random(5)
    head = [(owner, f"expense|{c}|", "expense", c, None, [rng.gauss(0, 1) for _ in range(3)], -float(i)) for owner in (1, 2) for i, c in enumerate("AB")]
    rows = [(rng.choice([1, 2, 3, None]), f"t{i % 30}", [rng.gauss(0, 1) for _ in range(3)]) for i in range(40)] + [(1, "hole", [1.0, None, 0.0])]
    monkeypatch.setattr(labels, "BLOCK_VECTORS", 5)
    columns = "owner_id bigint, label_id string, flow string, category string, subcategory string, weight array<double>, bias double"
    found = labels.predict(
        spark.createDataFrame(rows, "owner_id bigint, txn_id string, embedding array<double>"), spark.createDataFrame(head, columns)
    ).collect()

    def plain(owner, vector):
        known = [h for h in head if h[0] == owner]
        if not known or None in vector:
            return None
        norm = math.sqrt(sum(x * x for x in vector))
        raw = [math.exp(sum(a / norm * b for a, b in zip(vector, h[5])) * fv.SOFTMAX_TEMPERATURE + h[6]) for h in known]
        return max((r / sum(raw), h[1]) for r, h in zip(raw, known))

    want = Counter((o, t, *((p[1], round(p[0], 4)) if (p := plain(o, v)) else (None, None))) for o, t, v in rows)
    assert Counter((r.owner_id, r.txn_id, r.label_id, r.probability if r.probability is None else round(r.probability, 4)) for r in found) == want


def test_nearest_is_the_same_in_many_blocks(spark, monkeypatch):
    rng = random.Random(2)
    examples = spark.createDataFrame(
        [(1, f"e{i:03d}", f"M{i}", "expense", "Dining", None, rng.choice(["a", "b", None]), [rng.gauss(0, 1) for _ in range(4)], "m") for i in range(90)],
        "owner_id bigint, example_id string, merchant string, flow string, category string, subcategory string, institution_id string, embedding array<double>, embedding_model_id string",
    )
    rows = spark.createDataFrame(
        [(1, f"t{i}", "expense|Dining|", [rng.gauss(0, 1) for _ in range(4)], rng.choice(["a", None])) for i in range(40)],
        "owner_id bigint, txn_id string, label_id string, embedding array<double>, institution_id string",
    )
    whole = {(r.txn_id, r.position, r.example_id) for r in labels.nearest_examples(rows, examples, "m").collect()}
    monkeypatch.setattr(labels, "BLOCK_VECTORS", 7)
    assert {(r.txn_id, r.position, r.example_id) for r in labels.nearest_examples(rows, examples, "m").collect()} == whole
    assert len(whole) == 200


def test_undo_is_the_inverse_of_a_change(spark):
    stored = spark.createDataFrame([(1, "a", "x", None), (1, "b", "y", 2.5)], "owner_id bigint, key string, value string, score double")
    fresh = spark.createDataFrame([(1, "b", "Y", None), (1, "c", "z", 1.0)], stored.schema)
    keys = ["owner_id", "key"]
    images = review.before_image(stored, fresh, keys, "t", F.lit("op"))
    assert {(r.row_key, r.existed) for r in images.collect()} == {('{"owner_id":1,"key":"b"}', True), ('{"owner_id":1,"key":"c"}', False)}
    changed = tables.upsert(stored, fresh, keys, ["value", "score"])
    assert {(r.key, r.value) for r in changed.collect()} == {("a", "x"), ("b", "Y"), ("c", "z")}
    assert sorted(review.restore(changed, images, keys, "t").collect()) == sorted(stored.collect())


def test_shortlist_precedence(spark):
    df = spark.createDataFrame(
        [
            ("Expenses.Groceries", [("cabs", 0.2), ("fuel", 0.6), ("salary", 0.9), (None, 0.8), ("rent", float("nan"))], ["dining", "fuel"], "expense"),
            (None, None, ["refund", "refund", "dining"], "income"), ("nonsense", [], [], "transfer"), (None, None, None, "whatever"),
        ],
        "s string, d array<struct<category:string,p:double>>, f array<string>, flow string",
    )
    got = [r[0] for r in df.select(review.shortlist(F.col("s"), F.col("d"), F.col("f"), F.col("flow"))).collect()]
    assert got == [
        ["groceries", "fuel", "cabs", "dining", "housing"], ["refund", "salary", "interest", "dividend", "capital_gains"],
        ["self_transfer", "cc_payment", "atm_cash"], ["salary", "interest", "dividend", "capital_gains", "rental_income"],
    ]


def test_upsert_respects_ownership_and_purge_keeps_user_rows(spark):
    stored = spark.createDataFrame([("a", "old", "user"), ("b", "old", "pack:in"), ("c", "old", "pack:in"), ("d", "old", "user")], "id string, v string, source string")
    load = spark.createDataFrame([("a", "new", "pack:in"), ("b", "new", "pack:in"), ("e", "new", "pack:in")], stored.schema)
    merged = tables.upsert(stored, load, ["id"], ["v"], may_update="source = 'pack:in'")
    kept = tables.purge_absent(merged, load, ["id"], F.col("source") == "pack:in")
    assert {(r.id, r.v) for r in kept.collect()} == {("a", "old"), ("b", "new"), ("d", "old"), ("e", "new")}
    assert tables.purge_absent(merged, load.limit(0), ["id"], F.col("source") == "pack:in").count() == 5


def test_empty_references_and_seed_checks(spark):
    known = spark.createDataFrame([("x",)], "institution_id string")
    used = spark.createDataFrame([("x",), ("y",), (None,)], "institution_id string")
    assert ids(accounts.missing_references(used, known), "institution_id") == {"y"}
    repeated = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    assert ids(quality.duplicate_ids(repeated), "label") == {"a"}
