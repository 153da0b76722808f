"""Is the ledger complete and does it add up: balance chains, missing months, later corrections, open transfer legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import period
from ledgerloom.operators import scans

ACCOUNT = ["owner_id", "own_account_id"]
CHAIN = ["txn_date", "seq", "txn_id"]


# --------------------------------------------------------------------- balance chains
def balance_chain(rows: DataFrame, tolerance: int = 0, slices: int | None = None) -> DataFrame:
    """`rows` (with amount and a captured running `balance`, or null) plus expected_balance, difference and broken.

    Rows of an account are taken by (txn_date, seq, txn_id). What is expected after a row is the last captured balance
    before it plus all amounts since, its own included; the difference of a captured balance from that breaks the chain
    if it is over `tolerance`, and the chain goes on from the captured value. Rows without a balance, and the first captured one
    of an account, expect nothing and break nothing. Rows without an account are left out; a null amount counts as 0.
    """
    known = scans.sliced(rows.filter("own_account_id is not null"), ACCOUNT, CHAIN, slices)
    summed = scans.running_sum(known, ACCOUNT, CHAIN, "amount", "_total")
    # a chain without breaks has one drift: captured balance less the amounts so far
    drifts = summed.withColumn("_drift", F.col("balance") - F.col("_total"))
    chained = scans.previous_known(drifts, ACCOUNT, CHAIN, "_drift", "_before")
    expected = F.when(F.col("balance").isNotNull(), F.col("_before") + F.col("_total"))
    difference = F.col("_drift") - F.col("_before")
    return chained.withColumns(
        {
            "expected_balance": expected, "difference": difference,
            "broken": F.coalesce(F.abs(difference) > tolerance, F.lit(False)),
        }
    ).select(*rows.columns, "expected_balance", "difference", "broken")


def balance_card(chain: DataFrame) -> DataFrame:
    """One row per account and fiscal year: rows, captured balances, links checked, breaks and the first of them."""
    fy = period.fy_key(F.col("txn_date"))
    return chain.groupBy(*ACCOUNT, fy.alias("fy_key")).agg(
        F.count("*").alias("rows"), F.count("balance").alias("captured"), F.count("expected_balance").alias("checked"),
        F.count_if("broken").alias("breaks"), F.min(F.when(F.col("broken"), F.col("txn_date"))).alias("first_break"),
        F.sum(F.when(F.col("broken"), F.col("difference")).otherwise(0)).alias("unexplained"),
    )


# ---------------------------------------------------------------------- missing months
def _month(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date) - 1


def _first_day(month: Column) -> Column:
    return F.make_date(F.floor(month / 12).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1))


def _fiscal_year(month: Column) -> Column:
    """First calendar year of the fiscal year a month is in."""
    return F.floor((month - 3) / 12).cast("int")


def months_seen(rows: DataFrame, date: str = "txn_date") -> DataFrame:
    """The distinct months of each account. Map-side combined, so a hot account costs rows and not a task."""
    dated = rows.filter(F.col("own_account_id").isNotNull() & F.col(date).isNotNull())
    return dated.select(*ACCOUNT, _month(F.col(date)).alias("month")).distinct()


def month_gaps(rows: DataFrame, date: str = "txn_date") -> DataFrame:
    """(account, first_missing, last_missing, months): runs of months without rows between an account's first and last one.

    A gap is the distance from one seen month to the next, so no calendar is laid out. An account's window holds its
    distinct months, one calendar at most. Rows without an account or date are left out.
    """
    before = F.lag("month").over(Window.partitionBy(*ACCOUNT).orderBy("month"))
    steps = months_seen(rows, date).withColumn("before", before).filter("month - before > 1")
    return steps.select(
        *ACCOUNT, _first_day(F.col("before") + 1).alias("first_missing"), _first_day(F.col("month") - 1).alias("last_missing"),
        (F.col("month") - F.col("before") - 1).alias("months"),
    )


def month_islands(rows: DataFrame, date: str = "txn_date") -> DataFrame:
    """(account, first_month, last_month, months): the unbroken runs of months with rows."""
    place = F.row_number().over(Window.partitionBy(*ACCOUNT).orderBy("month"))
    runs = months_seen(rows, date).withColumn("run", F.col("month") - place)
    return runs.groupBy(*ACCOUNT, "run").agg(F.min("month").alias("low"), F.max("month").alias("high"), F.count("*").alias("months")).select(
        *ACCOUNT, _first_day(F.col("low")).alias("first_month"), _first_day(F.col("high")).alias("last_month"), "months"
    )


def month_completeness(rows: DataFrame, date: str = "txn_date") -> DataFrame:
    """Months seen and missing per account and fiscal year between the account's first and last month, and the share seen.

    Years that lie wholly inside a gap are listed too: only gaps are spread over the years they touch.
    """
    seen = months_seen(rows, date).groupBy(*ACCOUNT, _fiscal_year(F.col("month")).alias("fy")).agg(F.count("*").alias("seen"))
    gaps = month_gaps(rows, date).withColumns({"low": _month(F.col("first_missing")), "high": _month(F.col("last_missing"))})
    spread = gaps.withColumn("fy", F.explode(F.sequence(_fiscal_year(F.col("low")), _fiscal_year(F.col("high")))))
    inside = F.least(F.col("high"), F.col("fy") * 12 + 14) - F.greatest(F.col("low"), F.col("fy") * 12 + 3) + 1
    missing = spread.groupBy(*ACCOUNT, "fy").agg(F.sum(inside).alias("missing"))
    both = seen.withColumn("missing", F.lit(0).cast("bigint")).unionByName(missing.withColumn("seen", F.lit(0).cast("bigint")))
    total = both.groupBy(*ACCOUNT, "fy").agg(F.sum("seen").alias("seen"), F.sum("missing").alias("missing"))
    return total.select(
        *ACCOUNT, period.fy_key(F.make_date("fy", F.lit(4), F.lit(1))).alias("fy_key"), "seen", "missing",
        (F.col("seen") / (F.col("seen") + F.col("missing"))).alias("completeness"),
    )


# -------------------------------------------------------------------- later corrections
def accepted_outcomes(decisions: DataFrame, corrections: DataFrame, slices: int | None = None) -> DataFrame:
    """Each automatically accepted decision with the first correction of its transaction after it.

    decisions: owner_id, txn_id, prediction_id, category, decided_at; corrections: owner_id, txn_id, feedback_id, category, created_at.
    `outcome` is 'corrected' if that correction names another category, 'confirmed' if the same, 'untouched' without one. A correction at
    or before the decision says nothing about it. Of corrections at one time the least feedback_id counts.
    """
    later = corrections.select("owner_id", "txn_id", "feedback_id", F.col("category").alias("corrected_category"), F.col("created_at").alias("decided_at"))
    found = scans.next_after(decisions, later, ["owner_id", "txn_id"], "decided_at", ["feedback_id"], ["feedback_id", "corrected_category"], "_next", slices)
    same = F.col("_next.corrected_category").eqNullSafe(F.col("category"))
    return found.select(
        *decisions.columns, F.col("_next.feedback_id").alias("feedback_id"), F.col("_next.corrected_category").alias("corrected_category"),
        F.col("_next.decided_at").alias("corrected_at"),
        F.when(F.col("_next").isNull(), "untouched").when(same, "confirmed").otherwise("corrected").alias("outcome"),
    )


def accept_precision(outcomes: DataFrame) -> DataFrame:
    """Per owner and category: accepted decisions, how many were confirmed or corrected later, and the share that stood."""
    counted = outcomes.groupBy("owner_id", "category").agg(
        F.count("*").alias("accepted"), F.count_if(F.col("outcome") == "confirmed").alias("confirmed"),
        F.count_if(F.col("outcome") == "corrected").alias("corrected"),
    )
    return counted.withColumn("precision", (F.col("accepted") - F.col("corrected")) / F.col("accepted"))


# ----------------------------------------------------------------------- transfer closure
def link_violations(linked: DataFrame, window_days: int = fv.TRANSFER_WINDOW_DAYS) -> DataFrame:
    """Links that do not conserve money: (owner_id, debit_txn_id, credit_txn_id, violation), over `transfers.link_transfers` rows.

    A link must be named by both its legs, the legs must be a debit and a credit of opposite amounts at most `window_days` apart,
    and no leg may stand in two links. None is expected: pairing is one to one by construction, stored links need not be.
    """
    pair = ["owner_id", "debit_txn_id", "credit_txn_id"]
    ends = linked.filter(F.col("other_txn_id").isNotNull()).select(
        "owner_id", "txn_id", F.when(F.col("amount") < 0, F.col("txn_id")).otherwise(F.col("other_txn_id")).alias("debit_txn_id"),
        F.when(F.col("amount") < 0, F.col("other_txn_id")).otherwise(F.col("txn_id")).alias("credit_txn_id"), "amount", "txn_date",
    )
    links = ends.groupBy(*pair).agg(
        F.count("*").alias("ends"), F.sum("amount").alias("net"),
        F.count_if(F.col("amount") < 0).alias("debits"), F.count_if(F.col("amount") > 0).alias("credits"),
        period.days_between(F.max("txn_date"), F.min("txn_date")).alias("apart"),
    )
    uses = links.select(*pair, F.explode(F.array("debit_txn_id", "credit_txn_id")).alias("leg")).groupBy("owner_id", "leg").agg(F.count("*").alias("links"))
    shared = uses.filter("links > 1").select("owner_id", "leg")
    reused = links.select(*pair, F.explode(F.array("debit_txn_id", "credit_txn_id")).alias("leg")).join(shared, ["owner_id", "leg"]).select(*pair).distinct()
    checks = {
        "one leg only": F.col("ends") < 2, "more than two legs": F.col("ends") > 2,
        "same side": (F.col("ends") == 2) & ((F.col("debits") != 1) | (F.col("credits") != 1)),
        "amounts differ": (F.col("debits") == 1) & (F.col("credits") == 1) & (F.col("net") != 0),
        "too far apart": F.col("apart") > window_days,
    }
    failed = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]), lambda v: v.isNotNull())
    wrong = links.select(*pair, F.explode(failed).alias("violation"))
    return wrong.unionByName(reused.withColumn("violation", F.lit("leg in two links")))


def transfer_closure(linked: DataFrame, window_days: int = fv.TRANSFER_WINDOW_DAYS, old_days: int = 30, as_of: Column | None = None) -> DataFrame:
    """One row per owner over `transfers.link_transfers` rows: linked legs and their net, and open legs by age.

    An open leg is a transfer without its other leg, or a suspected one. Within `window_days` of the day of reckoning its
    other leg may still come; one older than `old_days` is overdue. That day is `as_of`, or the owner's last date. Legs
    without a date count as overdue. Rows are counted by owner, day and state first, so an owner's rows never meet in one task.
    """
    linked_leg = F.col("other_txn_id").isNotNull()
    single = F.coalesce("is_transfer", F.lit(False)) & ~linked_leg
    state = F.when(linked_leg, "linked").when(single, "single").when(F.col("suspected"), "suspected").otherwise("plain")
    daily = linked.groupBy("owner_id", "txn_date", state.alias("state")).agg(
        F.count("*").alias("rows"), F.sum("amount").alias("net"),
        F.sum(F.when(F.col("amount") < 0, F.col("amount")).otherwise(0)).alias("debits"),
        F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(0)).alias("credits"),
    )
    last = F.max("txn_date").over(Window.partitionBy("owner_id"))  # one row a day and state
    age = F.date_diff(as_of if as_of is not None else F.col("_last"), F.col("txn_date"))
    aged = daily.withColumn("_last", last).withColumn("age", F.coalesce(age, F.lit(2147483647)))

    def rows_of(name: str, test: Column) -> Column:
        return F.sum(F.when((F.col("state") == name) & test, F.col("rows")).otherwise(0))

    always, waiting, overdue = F.lit(True), F.col("age") <= window_days, F.col("age") > old_days
    columns = {
        "linked_legs": rows_of("linked", always),
        "linked_debits": F.sum(F.when(F.col("state") == "linked", F.col("debits")).otherwise(0)),
        "linked_credits": F.sum(F.when(F.col("state") == "linked", F.col("credits")).otherwise(0)),
    }
    for name in ("single", "suspected"):
        columns[f"{name}_waiting"] = rows_of(name, waiting)
        columns[f"{name}_open"] = rows_of(name, ~waiting & ~overdue)
        columns[f"{name}_overdue"] = rows_of(name, overdue)
    columns["suspected_amount"] = F.sum(F.when(F.col("state") == "suspected", F.col("net")).otherwise(0))
    summed = aged.groupBy("owner_id").agg(*[c.alias(n) for n, c in columns.items()])
    return summed.withColumns(
        {"balanced": F.col("linked_debits") + F.col("linked_credits") == 0, "closed": F.col("suspected_overdue") == 0}
    )
