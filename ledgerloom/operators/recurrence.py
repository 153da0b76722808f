"""Recurring charges and subscriptions.

Gaps are taken between distinct days of a key after a per-day count, so the only sorted group
is one key's calendar. Upper medians are never materialised where they are only compared with
a bound: `median <= bound` holds exactly when more than floor(n/2) values are <= bound, which
is a plain conditional count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import money, period, text
from ledgerloom.operators.rollups import top_per

Bands = list[tuple[str, int, int]]


def with_gap(days: DataFrame, keys: list[str]) -> DataFrame:
    """Days since the key's previous day, null on its first; `days` has one row per key and day."""
    previous = F.lag("txn_date").over(Window.partitionBy(*keys).orderBy("txn_date"))
    return days.withColumn("gap", F.datediff("txn_date", previous))


def day_gaps(rows: DataFrame, keys: list[str]) -> DataFrame:
    return with_gap(rows.groupBy(*keys, "txn_date").agg(F.count("*").alias("rows")), keys)


def gap_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distribution of consecutive-date gaps: repeats on one day are gaps of zero."""
    days = day_gaps(rows, keys)
    gaps = F.array(
        F.struct(F.col("gap").alias("gap"), F.lit(1).cast("bigint").alias("times")),
        F.struct(F.lit(0).alias("gap"), (F.col("rows") - 1).alias("times")),
    )
    spread = days.select(*keys, F.inline(gaps)).filter("gap is not null and times > 0")
    return spread.groupBy(*keys, "gap").agg(F.sum("times").alias("times"))


def upper_median_gap(rows: DataFrame, keys: list[str]) -> DataFrame:
    """sorted[floor(n/2)] of the gaps, read off their cumulative distribution."""
    window = Window.partitionBy(*keys)
    ordered = window.orderBy("gap").rowsBetween(Window.unboundedPreceding, 0)
    ranked = gap_rows(rows, keys).withColumns({"upto": F.sum("times").over(ordered), "total": F.sum("times").over(window)})
    reached = F.col("upto") > F.floor(F.col("total") / 2)
    return ranked.filter(reached).groupBy(*keys).agg(F.min("gap").alias("median_gap"))


def band_of_gaps(days: DataFrame, keys: list[str], bands: Bands, extra: list[Column]) -> DataFrame:
    """Cadence whose band holds the upper-median gap, plus `occurrences` and extra aggregates."""
    aggregates = [F.sum("rows").alias("occurrences")]
    same_day = F.sum(F.col("rows") - 1)
    for name, low, high in bands:
        aggregates.append((F.count_if(F.col("gap") < low) + same_day).alias(f"below_{name}"))
        aggregates.append((F.count_if(F.col("gap") <= high) + same_day).alias(f"upto_{name}"))
    grouped = days.groupBy(*keys).agg(*aggregates, *extra)
    middle = F.floor((F.col("occurrences") - 1) / 2)
    cadence = F.lit(None).cast("string")
    for name, _, _ in reversed(bands):
        inside = (F.col("occurrences") >= 2) & (F.col(f"below_{name}") <= middle) & (F.col(f"upto_{name}") > middle)
        cadence = F.when(inside, F.lit(name)).otherwise(cadence)
    helpers = [f"{side}_{name}" for name, _, _ in bands for side in ("below", "upto")]
    return grouped.withColumn("cadence", cadence).drop(*helpers)


def recurrence_index(ledger: DataFrame, merchant: Column | None = None, keys: tuple[str, ...] = ("owner_id",)) -> DataFrame:
    """Signatures charged on a monthly, quarterly or yearly rhythm.

    `merchant` is the parser's merchant when it has one; the description is used otherwise.
    """
    # never null, so a join on the signature needs no null test, which would compute it again at the scan
    named = [F.col("raw_description"), F.lit("")]
    described = F.coalesce(*named) if merchant is None else F.coalesce(merchant, *named)
    debits = ledger.filter("amount < 0").withColumn("signature", text.signature(described))
    group = [*keys, "signature"]
    days = debits.groupBy(*group, "txn_date").agg(
        F.count("*").alias("rows"), F.count_if(F.abs("amount") <= fv.MAX_RECURRING_MINOR).alias("small")
    )
    index = band_of_gaps(with_gap(days, group), group, fv.RECURRENCE_BANDS, [F.sum("small").alias("small")])
    affordable = F.col("small") > F.floor(F.col("occurrences") / 2)
    wanted = (F.col("occurrences") >= fv.MIN_RECURRENCES) & affordable & F.col("cadence").isNotNull()
    # asked of the few signatures that are left. As one expression with the counts it cannot be pushed below them, where
    # every row would compute its signature once for the test and again for the group
    usable = (F.col("signature") != "") & ~text.matches(F.col("signature"), fv.STRUCTURAL_RECURRENCE_PATTERN)
    return index.filter(F.when(wanted, usable).otherwise(False)).select(*group, "cadence", "occurrences")


def subscription_candidates(ledger: DataFrame) -> DataFrame:
    """Charges that may be subscriptions, with the key they are grouped by."""
    category = F.coalesce("category", F.lit("Uncategorised"))
    spend = ledger.filter((F.col("flow") == "expense") & ~F.col("is_internal_transfer") & (F.col("amount") < 0))
    spend = spend.withColumn("category", category).filter(~F.col("category").isin(fv.STRUCTURAL_CATEGORIES))
    canonical = F.when((F.col("merchant") != "") & F.col("layer").isin(fv.CANONICAL_LAYERS), F.col("merchant"))
    known = canonical.isNotNull() & F.col("category").isin(fv.SUBSCRIPTION_CATEGORIES)
    described = F.coalesce("raw_description", F.lit(""))
    key = F.when(known, F.concat(F.lit("m:"), F.lower(canonical))).when(
        F.col("category") == "Subscriptions", F.concat(F.lit("s:"), text.signature(described))
    )
    keyed = spend.withColumns({"subscription_key": key, "canonical": canonical, "known": known})
    return keyed.filter(F.col("subscription_key").isNotNull() & ~F.col("subscription_key").endswith(":"))


def detect_subscriptions(ledger: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """One row per merchant or recurring descriptor; statuses a user set survive by id."""
    keys = ["owner_id", "subscription_key"]
    charge = F.abs("amount")
    at = F.struct("txn_date", "txn_id")
    days = subscription_candidates(ledger).groupBy(*keys, "txn_date").agg(
        F.count("*").alias("rows"),
        F.count_if(charge < fv.MIN_UNKNOWN_SUBSCRIPTION_MINOR).alias("tiny"),
        F.max(F.struct(at.alias("at"), charge.alias("amount"))).alias("last"),
        F.min(F.struct(at.alias("at"), F.col("canonical"), F.col("raw_description"), F.col("category"), F.col("known"))).alias("first"),
    )
    groups = band_of_gaps(
        with_gap(days, keys), keys, fv.SUBSCRIPTION_BANDS,
        [F.sum("tiny").alias("tiny"), F.max("last").alias("last"), F.min("first").alias("first")],
    ).select(
        *keys, "occurrences", "cadence", "tiny",
        F.col("last.amount").alias("amount"), F.col("last.at.txn_date").alias("last_seen"),
        F.col("first.at").alias("first_at"),
        # the label is built once per group, not once per charge
        F.coalesce("first.canonical", text.clean_label(F.coalesce("first.raw_description", F.lit("")))).alias("label"),
        F.col("first.category").alias("category"), F.col("first.known").alias("known"),
    )
    assumed = F.when((F.col("occurrences") == 1) & (F.col("amount") >= fv.LONE_YEARLY_MINOR), "yearly").otherwise("monthly")
    substantial = F.col("tiny") <= F.floor(F.col("occurrences") / 2)
    readable = F.regexp_count("label", F.lit("[A-Za-z]")) >= 3
    recurring = (F.col("occurrences") >= fv.MIN_RECURRENCES) & F.col("cadence").isNotNull() & substantial & readable
    resolved = groups.filter(F.col("known") | recurring).withColumns(
        {
            "cadence": F.coalesce("cadence", assumed),
            "subscription_id": F.concat(F.lit("sub_"), text.shortened(text.slug(F.col("subscription_key")), 48)),
        }
    )
    unique = top_per(resolved, ["owner_id", "subscription_id"], [F.col("first_at")], 1)
    status = F.when(F.col("known"), "confirmed").otherwise("likely")
    if previous is not None:
        earlier = previous.select("owner_id", "subscription_id", F.col("status").alias("previous_status"))
        unique = unique.join(earlier, ["owner_id", "subscription_id"], "left")
        status = F.coalesce("previous_status", status)
    return unique.select(
        "owner_id", "subscription_id", F.substring("label", 1, 60).alias("merchant"), "amount", "cadence",
        status.alias("status"), F.col("first_at.txn_date").alias("first_seen"), "last_seen",
        period.add_cadence(F.col("last_seen"), F.col("cadence")).alias("next_charge"), "occurrences", "category",
    )


def set_status(subscriptions: DataFrame, changes: DataFrame) -> DataFrame:
    """User changes (owner_id, subscription_id, new_status) within the three known statuses."""
    valid = changes.filter(F.col("new_status").isin("confirmed", "likely", "dismissed"))
    return (
        subscriptions.join(valid, ["owner_id", "subscription_id"], "left")
        .withColumn("status", F.coalesce("new_status", "status")).drop("new_status")
    )


def annual_cost(subscriptions: DataFrame) -> DataFrame:
    per_year = F.create_map(*[F.lit(x) for pair in fv.CADENCE_PER_YEAR.items() for x in pair])
    cadence = F.coalesce("cadence", F.lit("monthly"))
    major = money.to_major(F.col("amount"))
    times = F.coalesce(per_year[cadence], F.lit(12))
    return subscriptions.withColumns({"amount_major": major, "annual": (major * times).cast("bigint")})


def totals(subscriptions: DataFrame, as_of: Column) -> DataFrame:
    """Confirmed annual cost, its monthly equivalent, and the next renewal on or after a date."""
    confirmed = annual_cost(subscriptions).filter("status = 'confirmed'")
    upcoming = F.when(F.col("next_charge") >= as_of, F.struct("next_charge", "subscription_id"))
    totals_ = confirmed.groupBy("owner_id").agg(F.sum("annual").alias("annual_total"), F.min(upcoming).alias("next"))
    return totals_.select(
        "owner_id", "annual_total", money.js_round(F.col("annual_total") / 12).alias("monthly_equivalent"),
        F.col("next.subscription_id").alias("next_subscription_id"), F.col("next.next_charge").alias("next_charge"),
    )
