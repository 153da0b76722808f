"""Fiscal-period rollups over a classified ledger.

Every rollup is keyed by (owner_id, fy_key) and built from associative aggregates, so Spark
combines on the map side and an owner that holds a large share of the rows costs one partial
row per task. Ranked lists filter a row_number, which Spark turns into a per-task group limit
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import money, period

PERIOD = ["owner_id", "fy_key"]
def spending() -> Column:
    return (F.col("flow") == "expense") & ~F.col("is_internal_transfer")


def income() -> Column:
    """Income views also leave out suspected transfers."""
    return (F.col("flow") == "income") & ~F.col("is_internal_transfer") & ~F.col("suspected_transfer")


def merchant_name() -> Column:
    return F.coalesce("merchant", "subcategory", "category")


def sum_if(condition: Column, value: Column | str = "amount") -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0).cast("bigint"))


def top_per(df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str | None = None) -> DataFrame:
    """First `limit` rows of each key in a total order; pruned per task before the shuffle."""
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= limit)
    return ranked if rank else ranked.drop(name)


def flow_sums(ledger: DataFrame) -> DataFrame:
    outflow = ~F.col("is_internal_transfer")
    return ledger.groupBy(*PERIOD).agg(
        sum_if(income()).alias("income_minor"),
        sum_if(outflow & (F.col("flow") == "expense")).alias("expense_minor"),
        sum_if(outflow & (F.col("flow") == "investment")).alias("investment_minor"),
        F.count("*").alias("txn_count"),
    )


def overview(ledger: DataFrame) -> DataFrame:
    """Income, spending, investments, savings rate and last year's savings rate."""
    totals = flow_sums(ledger).select(
        *PERIOD,
        money.to_major(F.col("income_minor")).alias("income"),
        money.to_major(F.abs("expense_minor")).alias("expenses"),
        money.to_major(F.abs("investment_minor")).alias("invested"),
        "txn_count",
    )
    rate = money.savings_rate(F.col("income"), F.col("expenses"))
    # the ledger is read once; a window over an owner's few years sees only the year just before
    before = Window.partitionBy("owner_id").orderBy(F.substring("fy_key", 1, 4).cast("int")).rangeBetween(-1, -1)
    rated = totals.withColumn("rate", rate)
    return rated.withColumn("prev_savings_rate", F.max("rate").over(before)).select(
        *PERIOD, "income", "expenses", "invested",
        (F.col("income") - F.col("expenses")).alias("net"),
        F.col("rate").alias("savings_rate"),
        F.coalesce("prev_savings_rate", F.lit(0).cast("bigint")).alias("prev_savings_rate"),
        "txn_count",
    )


def top_spending(ledger: DataFrame, name: Column, limit: int, default: str) -> DataFrame:
    totals = ledger.filter(spending()).groupBy(*PERIOD, name.alias("name")).agg(F.sum(F.abs("amount")).alias("minor"))
    ranked = top_per(totals, PERIOD, [F.desc("minor"), F.asc_nulls_first("name")], limit, "position")
    return ranked.select(
        *PERIOD, "position", F.coalesce("name", F.lit(default)).alias("name"), money.to_major(F.col("minor")).alias("amount")
    )


def top_categories(ledger: DataFrame) -> DataFrame:
    return top_spending(ledger, F.col("category"), 6, "Uncategorised")


def top_merchants(ledger: DataFrame) -> DataFrame:
    return top_spending(ledger, merchant_name(), 5, "Unknown")


def display_rows(ledger: DataFrame, messages: DataFrame) -> DataFrame:
    """Display projection with provenance and the message the row came from."""
    source = messages.select("message_id", "from_addr", "subject")
    return ledger.join(source, "message_id", "left").select(
        "owner_id", "fy_key", "txn_id", "txn_date",
        F.coalesce(merchant_name(), F.lit("Unknown")).alias("merchant"),
        F.coalesce("category", F.lit("Uncategorised")).alias("category"),
        "subcategory",
        money.to_major(F.col("amount")).alias("amount"),
        F.coalesce("flow", F.lit("expense")).alias("flow"),
        "confidence", "layer", "reason", "signal", "source", "accepted_prediction_id",
        F.coalesce("review_required", F.lit(False)).alias("review_required"),
        "tax_section", "from_addr", "subject",
    )


def latest(ledger: DataFrame, keys: list[str], limit: int) -> DataFrame:
    return top_per(ledger, keys, [F.desc("txn_date"), F.col("txn_id")], limit)


def recent(ledger: DataFrame, messages: DataFrame, condition: Column | None, limit: int) -> DataFrame:
    """Latest rows of each period; ranked before the join, so only the kept rows are joined."""
    chosen = ledger if condition is None else ledger.filter(condition)
    return display_rows(latest(chosen, PERIOD, limit), messages)


def income_months(ledger: DataFrame) -> DataFrame:
    """Twelve fiscal months per period, salary and other, each row rounded before it is summed."""
    rounded = money.to_major(F.col("amount"))
    month = period.fiscal_month_number(F.col("txn_date"))
    salary = F.coalesce(F.lower("category") == "salary", F.lit(False))
    sums = []
    for number in range(1, 13):
        sums.append(sum_if((month == number) & salary, rounded).alias(f"salary_{number}"))
        sums.append(sum_if((month == number) & ~salary, rounded).alias(f"other_{number}"))
    wide = ledger.filter(income()).groupBy(*PERIOD).agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("month_no"),
                F.lit(fv.FISCAL_MONTHS[n - 1]).alias("month"),
                F.col(f"salary_{n}").alias("salary"),
                F.col(f"other_{n}").alias("other"),
            )
            for n in range(1, 13)
        ]
    )
    return wide.select(*PERIOD, F.inline(rows))


def income_totals(ledger: DataFrame) -> DataFrame:
    rounded = money.to_major(F.col("amount"))
    salary = F.coalesce(F.lower("category") == "salary", F.lit(False))
    first_seen = F.struct("txn_date", "txn_id")
    return (
        ledger.groupBy(*PERIOD)
        .agg(
            sum_if(income() & salary, rounded).alias("salary_total"),
            sum_if(income() & ~salary, rounded).alias("other_total"),
            F.min_by(
                F.when(salary, F.col("subcategory")), F.when(salary & F.col("subcategory").isNotNull(), first_seen)
            ).alias("employer"),
            F.count_if(income()).alias("income_rows"),
        )
        .withColumn("total", F.col("salary_total") + F.col("other_total"))
    )


def expense_children(ledger: DataFrame) -> DataFrame:
    """Spending by category and subcategory, rounded per subgroup."""
    return (
        ledger.filter(spending())
        .groupBy(*PERIOD, "category", "subcategory")
        .agg(
            F.sum(F.abs("amount")).alias("minor"),
            F.max(F.col("is_recurring").cast("int")).alias("recurring"),
            F.max("project_id").alias("project"),
        )
        .select(
            *PERIOD, F.coalesce("category", F.lit("Uncategorised")).alias("category"), "subcategory",
            money.to_major(F.col("minor")).alias("amount"), "recurring", "project",
        )
    )


def expense_tree(ledger: DataFrame) -> DataFrame:
    """Category totals as sums of already rounded subcategory totals."""
    return (
        expense_children(ledger)
        .groupBy(*PERIOD, "category")
        .agg(
            F.sum("amount").alias("amount"),
            (F.max("recurring") == 1).alias("recurring"),
            F.max("project").alias("project"),
            F.count("subcategory").alias("children"),
        )
    )


def category_share(ledger: DataFrame) -> DataFrame:
    """Share of the period's spending and of its largest category."""
    tree = expense_tree(ledger).select(*PERIOD, "category", "amount")
    whole = tree.groupBy(*PERIOD).agg(F.sum("amount").alias("total"), F.max("amount").alias("largest"))
    return tree.join(whole, PERIOD).select(
        *PERIOD, "category", "amount",
        money.percent(F.col("amount"), F.col("total")).alias("pct_of_total"),
        money.percent(F.col("amount"), F.col("largest")).alias("pct_of_largest"),
    )


def tax_sections(ledger: DataFrame) -> DataFrame:
    """Tagged amounts by the tag as spelled: two spellings of one section stay two rows."""
    return (
        ledger.filter(F.col("tax_section").isNotNull())
        .groupBy(*PERIOD, "tax_section")
        .agg(F.sum(F.abs("amount")).alias("minor"), F.count("*").alias("evidence"))
    )


def rent_totals(ledger: DataFrame) -> DataFrame:
    rent = (F.col("flow") == "expense") & (F.lower("subcategory") == "rent")
    return (
        ledger.filter(rent).groupBy(*PERIOD)
        .agg(F.sum(F.abs("amount")).alias("rent_minor"), F.count("*").alias("rent_rows"))
    )


def investments(ledger: DataFrame) -> DataFrame:
    platform = F.coalesce("subcategory", "institution_id", F.lit("Investments"))
    return (
        ledger.filter(F.col("flow") == "investment")
        .groupBy(*PERIOD, platform.alias("platform"))
        .agg(money.to_major(F.sum(F.abs("amount"))).alias("invested"))
    )


def loans(ledger: DataFrame) -> DataFrame:
    name = F.coalesce("subcategory", "category")
    return (
        ledger.filter(F.lower("category") == "loan")
        .groupBy(*PERIOD, name.alias("name"))
        .agg(money.to_major(F.max(F.abs("amount"))).alias("emi"), F.max("tax_section").alias("tax_section"))
    )


def insurance(ledger: DataFrame) -> DataFrame:
    name = F.coalesce("merchant", "subcategory", F.lit("Insurance"))
    return (
        ledger.filter(F.lower("category") == "insurance")
        .groupBy(*PERIOD, name.alias("name"))
        .agg(
            money.to_major(F.sum(F.abs("amount"))).alias("premium"),
            F.coalesce(F.max("tax_section"), F.lit("80D")).alias("section"),
        )
    )


def available_periods(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("fy_key").isNotNull()).select(*PERIOD).distinct()


def latest_period(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("owner_id").agg(F.max("fy_key").alias("fy_key"))


def cashflow(ledger: DataFrame) -> DataFrame:
    """Per-flow sums, then magnitudes; transfers inside income are not removed here."""
    flow = F.col("flow")
    sums = ledger.groupBy(*PERIOD).agg(
        sum_if(flow == "income").alias("income"),
        sum_if(flow == "expense").alias("expense"),
        sum_if(flow == "investment").alias("investment"),
    )
    outflow = F.abs("expense") + F.abs("investment")
    return sums.select(*PERIOD, "income", outflow.alias("outflow"), (F.col("income") - outflow).alias("net"))


def category_spend(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(*PERIOD, "category").agg(F.sum(F.abs("amount")).alias("total"), F.count("*").alias("rows"))


def source_runs(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Per-run message count and bytes, and the share of attachments that were extracted."""
    runs = messages.groupBy("run_id").agg(F.count("*").alias("messages"), F.sum("bytes").alias("bytes"))
    landed = attachments.groupBy("run_id").agg(
        F.count("*").alias("attachments"), F.count_if(F.col("status") == "extracted").alias("extracted")
    )
    return runs.join(landed, "run_id", "left").select(
        "run_id", "messages", money.human_bytes(F.col("bytes")).alias("size"),
        F.coalesce("attachments", F.lit(0).cast("bigint")).alias("attachments"),
        F.when(F.col("attachments") > 0, money.percent(F.col("extracted"), F.col("attachments"))).alias("coverage"),
    )


def review_summary(ledger: DataFrame, review_items: DataFrame) -> DataFrame:
    """Locked documents plus uncategorised and low-confidence rows awaiting review."""
    pending = ledger.filter("review_required").groupBy("owner_id").agg(
        F.count_if(F.lower("category") == "uncategorised").alias("uncategorised"),
        F.count_if(F.lower("category") != "uncategorised").alias("low_confidence"),
    )
    locked = (
        review_items.filter((F.col("status") == "open") & (F.col("kind") == "locked_pdf"))
        .groupBy("owner_id").agg(F.count("*").alias("locked"))
    )
    zero = F.lit(0).cast("bigint")
    counts = [F.coalesce(c, zero).alias(c) for c in ("locked", "uncategorised", "low_confidence")]
    return (
        pending.join(locked, "owner_id", "full_outer").select("owner_id", *counts)
        .withColumn("total", F.col("locked") + F.col("uncategorised") + F.col("low_confidence"))
    )


def category_frequency(ledger: DataFrame, limit: int = fv.FREQUENT_CATEGORY_LIMIT) -> DataFrame:
    """Each owner's most used settled categories."""
    key = F.lower("category")
    settled = ledger.filter(~F.col("review_required") & (F.col("category") != "") & (key != "uncategorised"))
    counts = settled.groupBy("owner_id", key.alias("category")).agg(F.count("*").alias("rows"))
    return top_per(counts, ["owner_id"], [F.desc("rows"), F.col("category")], limit, "position")


def profile_completeness(fields: DataFrame) -> DataFrame:
    """Filled share per section; repeat slots after the first count only once they are started.

    `fields`: owner_id, section, entity (null outside repeat groups), slot, field, value,
    read_only, editable (whether the section counts towards the overall share).
    """
    live = fields.withColumn("filled", F.trim("value") != "")
    slots = ["owner_id", "section", "entity", "slot"]
    by_slot = live.filter(~F.col("read_only")).groupBy(*slots, "editable").agg(
        F.count("*").alias("fields"), F.count_if("filled").alias("filled")
    )
    counted = F.col("entity").isNull() | (F.col("slot") == 0) | (F.col("filled") > 0)
    by_section = by_slot.groupBy("owner_id", "section", "editable").agg(
        sum_if(counted, "fields").alias("fields"), sum_if(counted, "filled").alias("filled")
    )
    return by_section.select(
        "owner_id", "section", "editable",
        F.when(F.col("fields") == 0, F.lit(100).cast("bigint"))
        .otherwise(money.percent(F.col("filled"), F.col("fields"))).alias("pct"),
    )


def profile_overall(sections: DataFrame) -> DataFrame:
    counted = sections.filter("editable")
    return counted.groupBy("owner_id").agg(money.js_round(F.avg("pct")).alias("overall"))


# ------------------------------------------------------------------------- row filters
def search(ledger: DataFrame, needle: str) -> DataFrame:
    """Literal case-insensitive substring over four columns, or an exact amount when it is a number."""
    wanted = F.lit(needle.lower().strip())
    columns = ["merchant", "raw_description", "category", "subcategory"]
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), wanted)
    number = F.regexp_replace(F.lit(needle), r"[₹,\s]", "").try_cast("double")
    by_amount = F.coalesce((number > 0) & (F.abs("amount") == money.js_round(number * 100)), F.lit(False))
    return ledger.filter(hit | by_amount)


def list_rows(ledger: DataFrame, like: str | None = None, **equals) -> DataFrame:
    """Optional equality and pattern conjuncts; the pattern keeps its wildcards."""
    for name, value in equals.items():
        if value is not None:
            ledger = ledger.filter(F.col(name) == value)
    if like:
        wanted = f"%{like.lower()}%"
        columns = ["merchant", "raw_description", "category"]
        hits = [F.lower(F.coalesce(F.col(c), F.lit(""))).like(wanted) for c in columns]
        ledger = ledger.filter(hits[0] | hits[1] | hits[2])
    return ledger


def merchant_search(ledger: DataFrame, merchant: str) -> DataFrame:
    wanted = "%" + merchant.replace("%", "").replace("_", "").strip() + "%"
    return ledger.filter(F.col("merchant").ilike(wanted) | F.col("raw_description").ilike(wanted))


def provenance(ledger: DataFrame, txn_id: str | None = None, merchant: str | None = None) -> DataFrame:
    if txn_id is not None:
        ledger = ledger.filter(F.col("txn_id") == txn_id)
    if merchant is not None:
        ledger = ledger.filter(F.col("merchant").ilike("%" + merchant.replace("%", "").replace("_", "") + "%"))
    return ledger.select(
        "owner_id", "txn_id", "txn_date", "merchant", "category", "subcategory", "source",
        "accepted_prediction_id", "layer", "reason", "raw_description",
    )
