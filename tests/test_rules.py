"""Positive and negative rows per rule layer; all text is invented."""

import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.operators import rules

LEDGER = "owner_id bigint, txn_id string, txn_date date, amount bigint, raw_description string, counterparty_raw string"
DAY = datetime.date(2024, 5, 6)
ALIAS = "pattern string, canonical_merchant string, category string, subcategory string, source string, confidence string, seq int"
OVERRIDE = "owner_id bigint, match_signature string, seq int, flow string, category string, subcategory string, merchant string, tax_section string, note string"

PROFILE = (
    1, ("Acme", ["acme payroll"], 5_000_000), ("Ms Rao", 3_000_000),
    [("Mina", "cook", 400_000, None), ("Ravi", "driver", None, "ravi@okbank")],
    [(None, "home", 2_500_000), (None, "auto", 900_000)], [("b", "7702", "Blue card")],
    [("growfund", "Grow Fund", "80C"), ("invapp", "Inv App", None)], [(None, "Safe Health", "health", "80D")],
    [("p1", "Kitchen", datetime.date(2024, 6, 1), datetime.date(2024, 6, 30), ["tiles", "groceries"])],
)


def classify(spark, rows, aliases=(), overrides=(), rhythm=(), providers=None):
    full = [(1, f"t{i}", r[2] if len(r) > 2 else DAY, r[1], r[0], None) for i, r in enumerate(rows)]
    out = rules.classify(
        spark.createDataFrame(full, LEDGER),
        spark.createDataFrame([PROFILE], rules.PROFILE_SCHEMA),
        spark.createDataFrame(list(overrides), OVERRIDE),
        spark.createDataFrame(list(aliases), ALIAS),
        spark.createDataFrame(list(rhythm), "owner_id bigint, signature string, cadence string, occurrences bigint"),
        providers,
    ).collect()
    by_id = {r.txn_id: r.verdict for r in out}
    assert len(by_id) == len(rows)
    return [by_id[f"t{i}"] for i in range(len(rows))]


def test_profile_layer(spark):
    rows = [
        ("NEFT ACME PAYROLL MAY", 5_100_000), ("neft acme payroll bonus", 9_000_000), ("refund to acme payroll", -100),
        ("paid xx7702 bill", -100), ("ref 9977027702 lunch", -100), ("blue card due", -100),
        ("upi ms rao", -3_000_000), ("ms rao gift", -100), ("may rent", -3_010_000), ("parent gift", -9_010_000),
        ("upi mina", -420_000), ("upi RAVI@okbank", -1), ("loan emi 04", -10), ("premium paid", -10), ("something", -2_510_000),
        ("grow fund sip", -10), ("safe health policy", -10), ("grow fund payout", 10),
    ]
    got = [(v.signal, v.confidence, v.flow) for v in classify(spark, rows)]
    assert got == [
        ("profile.employer", "high", "income"), ("profile.employer", "med", "income"), (None, "low", "expense"),
        ("transfer.cc_payment", "high", "transfer"), (None, "low", "expense"), ("transfer.cc_payment", "high", "transfer"),
        ("profile.home.rent", "high", "expense"), ("profile.home.rent", "med", "expense"), ("profile.home.rent", "med", "expense"), (None, "low", "expense"),
        ("profile.house_help", "high", "expense"), ("profile.house_help", "high", "expense"), ("profile.loan", "med", "expense"), (None, "low", "expense"),
        ("profile.loan", "high", "expense"), ("profile.broker.growfund", "high", "investment"), ("profile.insurer", "high", "expense"), (None, "low", "income"),
    ]


def test_alias_beats_an_amount_coincidence_and_longest_wins(spark):
    aliases = [
        ("plum", "Plum", "expenses.food", "cafes", "pack:in", "high", 1), ("plum eats", "Plum Eats", "expenses.food_delivery", None, "user", "med", 2),
        ("stash", "Stash", "investment.funds", "sip", "pack:in", "high", 3), ("qq", "Short", "expenses.misc", None, "user", "high", 4),
        ("abcd", "First", "a", None, "user", "high", 5), ("bcde", "Second", "b", None, "user", "high", 6),
    ]
    rows = [("PLUM EATS 12", -100), ("plum", -100), ("stash sip", -2_500_000), ("stash out", 100), ("a qq b", -100), ("abcde", -100)]
    got = [(v.merchant, v.category, v.flow, v.signal, v.layer) for v in classify(spark, rows, aliases)]
    assert got == [
        ("Plum Eats", "Food Delivery", "expense", "user.merchant_alias", 4), ("Plum", "Food", "expense", "pack.merchants.cafes", 4),
        ("Stash", "Funds", "investment", "pack.merchants.sip", 4), ("Stash", "Funds", "income", "pack.merchants.sip", 4),
        ("Short", "Misc", "expense", "user.merchant_alias", 4), ("First", "A", "expense", "user.merchant_alias", 4),
    ]


def test_keywords_fit_words_and_signs(spark):
    rows = [
        ("gastro pub", -100), ("city gas", -100), ("interest", -100), ("interest", 100), ("pinterest ads", 100), ("pay@cred.club", 100),
        ("BIL/ONL/0042/BILL  DESK/CRED_ab12/MKS-77", -100), ("BIL/ONL/0042/BILL DESK/water", -100), ("upi autopay songs", -100),
    ]
    got = [(v.signal, v.review_required) for v in classify(spark, rows)]
    assert got == [
        (None, True), ("keyword.gas", True), (None, True), ("keyword.interest", True), (None, True), ("keyword.cred.club", False),
        ("keyword.cred_billdesk_cc_payment", False), (None, True), (None, True),
    ]


def test_override_recurrence_provider_and_order(spark):
    overrides = [
        (1, "corner shop", 2, None, "Late", None, "Late", None, None), (1, "corner shop", 1, None, "Investment", None, "Mine", "80C", None),
        (2, "other owner", 1, None, "X", None, None, None, None),
    ]
    rhythm = [(1, "songs monthly", "monthly", 6), (1, "gym", "monthly", 3)]
    providers = spark.createDataFrame(
        [(1, "p1", "Power Co", ["power", "power board"], "Utilities", None, None), (2, "p2", "Board", ["r board"], "Fees", None, "expense")],
        "seq int, institution_id string, display_name string, patterns array<string>, category string, subcategory string, flow string",
    )
    rows = [("CORNER shop 9912", -100), ("other owner", -100), ("songs monthly", -100), ("gym 1", -100), ("songs monthly", 100), ("the power board", -5), ("a power", 5)]
    got = [(v.layer, v.category, v.flow, v.confidence) for v in classify(spark, rows, (), overrides, rhythm, providers)]
    assert got == [
        (1, "Investment", "investment", "high"), (7, "Uncategorised", "expense", "low"), (6, "Subscriptions", "expense", "high"),
        (6, "Subscriptions", "expense", "med"), (7, "Uncategorised", "income", "low"), (3, "Utilities", "expense", "high"), (3, "Utilities", "income", "high"),
    ]


def test_project_isolation_only_restamps_expenses_in_the_window(spark):
    june = datetime.date(2024, 6, 30)
    rows = [("wall tiles", -100, june), ("wall tiles", -100, datetime.date(2024, 7, 1)), ("wall tiles", 100, june), ("paint", -100, june)]
    assert [v.project_id for v in classify(spark, rows)] == ["p1", None, None, None]


@pytest.mark.parametrize("raw,expected", [(None, "unknown"), ("pay Asha@ok", "known_own"), ("ab", "unknown"), ("x 4321", "external"), ("mine@bank", "own_account")])
def test_counterparty(spark, raw, expected):
    entries = [
        ("a", "family", True, ["asha@"], None, None), ("b", "other_own", True, None, ["ab"], None),
        ("c", "broker", False, None, None, ["4321"]), ("d", "own_account", True, None, ["mine"], None),
    ]
    kind = "array<struct<id:string,kind:string,is_own_money:boolean,vpa_fragments:array<string>,name_tokens:array<string>,last4:array<string>>>"
    registry = spark.createDataFrame([(1, entries)], f"owner_id bigint, entries {kind}")
    rows = spark.createDataFrame([(1, raw)], "owner_id bigint, counterparty_raw string")
    assert rules.resolve_counterparty(rows, registry).first().counterparty_kind == expected


def test_automata_against_a_scan(spark):
    """Longest pattern, then the earliest; short, nested and repeated patterns, texts without any, and many small parts."""
    import random

    from pyspark.sql import functions as F

    from ledgerloom.operators import rules

    rng = random.Random(3)
    word = lambda low, high: "".join(rng.choice("ab é") for _ in range(rng.randint(low, high)))
    patterns = [(word(0, 7), n, f"m{n}") for n in range(150)] + [("ab", 500, "late"), ("ab", -1, "early")]
    texts = [word(0, 40) for _ in range(300)] + [None, "", "zzz"]
    known = spark.createDataFrame(patterns, "pattern string, seq int, name string")
    frame = spark.createDataFrame([(t,) for t in texts + texts[:50]], "cleaned string")
    want = {}
    for t in {t for t in texts if t is not None}:
        inside = sorted((-len(p), seq, p, name) for p, seq, name in patterns if p and p in t)
        if inside:
            want[t] = (inside[0][2], inside[0][3], -inside[0][0] >= 5)
    for part_chars in (8_000_000, 60):
        got = rules.longest_pattern(frame, known, part_chars).select("cleaned", "rule.pattern", "rule.name", "evidence").collect()
        assert len(got) == len(want) and {r[0]: tuple(r[1:]) for r in got} == want
    assert rules.longest_pattern(frame, known.limit(0)).isEmpty() and rules.longest_pattern(frame.limit(0), known).isEmpty()
    assert rules.longest_pattern(frame.withColumn("other", F.lit(1)), known.filter("seq < 0")).count() == sum("ab" in (t or "") for t in set(texts))


def test_descriptions_are_read_once_whatever_their_rows(spark):
    """Null, repeated and differently spaced descriptions keep their rows; no null test repeats the expressions behind `cleaned`."""
    rows = [(1, f"t{i}", DAY, -100, d, None) for i, d in enumerate(["UPI  Plum 12", "UPI  Plum 12", "upi plum 12", None, "", "corner shop", "acme bank fee"])]
    known = spark.createDataFrame([("plum", "Plum", "expenses.food", None, "user", "high", 1)], ALIAS)
    providers = spark.createDataFrame(
        [("acme", "Acme Bank", ["acme bank"], "expense", "Fees", None, 1)],
        "institution_id string, display_name string, patterns array<string>, flow string, category string, subcategory string, seq int",
    )
    found = rules.attach_lookups(
        spark.createDataFrame(rows, LEDGER), spark.createDataFrame([PROFILE], rules.PROFILE_SCHEMA), spark.createDataFrame([], OVERRIDE), known,
        spark.createDataFrame([], "owner_id bigint, signature string, cadence string, occurrences bigint"), providers,
    )
    got = {r.txn_id: (r.cleaned, r.alias and r.alias.canonical_merchant, r.evidence, r.provider and r.provider.institution_id) for r in found.collect()}
    plum = ("upi plum 12", "Plum", False, None)
    assert got == {
        "t0": plum, "t1": plum, "t2": plum, "t3": ("", None, False, None), "t4": ("", None, False, None),
        "t5": ("corner shop", None, False, None), "t6": ("acme bank fee", None, False, "acme"),
    }
    assert found.count() == len(rows)
    assert "isnotnull(trim(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_rules_are_found_where_the_rows_are(spark):
    """One automaton: no exchange of the rows, the same rules as over distinct texts by many small parts; rows keep their number."""
    known = spark.createDataFrame([("ab", 5, "late"), ("ab", 1, "early"), ("abc", 9, "long"), ("bcd", 2, "other"), ("", 0, "none")], "pattern string, seq int, name string")
    rows = spark.createDataFrame([(1, "xab"), (2, "xab"), (3, "zabcd"), (4, None), (5, ""), (6, "zz"), (None, "bcd")], "id int, cleaned string")
    want = sorted([(1, "early"), (2, "early"), (3, "other"), (4, None), (5, None), (6, None), (0, "other")])
    for part_chars in (rules.PART_CHARS, 2):
        got = rules.with_longest_pattern(rows, known, "rule", part_chars)
        assert sorted((r.id or 0, r.rule and r.rule.name) for r in got.collect()) == want
    plan = rules.with_longest_pattern(rows, known, "rule")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert rules.with_longest_pattern(rows, known.limit(0), "rule").filter("rule is null").count() == 7


def test_the_household_joins_the_rows_last(spark):
    """No exchange carries it on: the joins by signature lie below the join by owner, and both signature tables share one."""
    empty = spark.createDataFrame([], LEDGER)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = rules.attach_lookups(
            empty, spark.createDataFrame([PROFILE], rules.PROFILE_SCHEMA), spark.createDataFrame([], OVERRIDE), spark.createDataFrame([], ALIAS),
            spark.createDataFrame([], "owner_id bigint, signature string, cadence string, occurrences bigint"),
        )
        plan = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert len(joins) <= 2 and (not joins or "signature" not in joins[0])


def test_a_rerun_compares_rows_in_place(spark):
    """With the old columns carried along, the rows are those of the join: repeated and null keys, null values, other owners."""
    before = [(1, "a", "x", "f", "m"), (1, "b", "x", "f", None), (1, "c", "x", "f", "m"), (1, "c", "y", "f", "m"), (1, "c", "y", "f", "m"), (2, "a", None, "f", "m"), (None, "a", "x", "f", "m"), (1, None, "x", "f", "m")]
    ledger = spark.createDataFrame(before, "owner_id long, txn_id string, category string, flow string, merchant string")
    new = ledger.withColumns({"category": F.when(F.col("txn_id") == "b", "z").otherwise(F.coalesce("category", F.lit("y")))})
    want = sorted(map(tuple, rules.changed_rows(ledger, new).select("owner_id", "txn_id", "category", "old_category").collect()), key=repr)
    carried = ledger.select("owner_id", "txn_id", *[F.col(c).alias(f"old_{c}") for c in ("category", "flow", "merchant")], "category", "flow", "merchant")
    after = carried.withColumns({"category": F.when(F.col("txn_id") == "b", "z").otherwise(F.coalesce("category", F.lit("y")))})
    found = rules.changed_rows(ledger, after)
    assert sorted(map(tuple, found.select("owner_id", "txn_id", "category", "old_category").collect()), key=repr) == want
    assert len(want) == 6 and found.columns == rules.changed_rows(ledger, new).columns


def test_a_rerun_puts_the_ledger_together_once(spark):
    found = entry.queries()["reclassify"](spark, "/root/testdata/sf0.001")
    assert not any(f.endswith("/lineitem.parquet") for f in found.inputFiles())
