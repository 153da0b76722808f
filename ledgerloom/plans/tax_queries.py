"""Tax over income and tagged line items, with the binding's years standing in for the supported ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.operators import tax
from ledgerloom.plans import bindings as b
from ledgerloom.plans.registry import query
from ledgerloom.plans.rollup_queries import SQL_INCOME, on_lines

YEARS = ["1997-98", "1998-99", "1999-00"]


def taxpayers(spark, sf_dir):
    """One taxpayer per customer and year: gross from orders, deductions from open orders."""
    o = b.ledger_orders(spark, sf_dir)
    positive = F.col("amount") > 0
    rows = o.groupBy("owner_id", "own_account_id", "fy_key").agg(
        F.sum(F.when(positive, F.col("amount")).otherwise(0)).alias("credit"),
        F.sum(F.when(positive, 0).otherwise(-F.col("amount"))).alias("debit"),
        F.min("seq").alias("seq"),
    )
    scale = F.when(F.col("seq") % 9 == 0, 10).when(F.col("seq") % 9 == 1, 200).otherwise(100)
    return rows.select(
        "own_account_id", "fy_key", F.call_function("div", F.col("credit") * 5, scale).alias("gross"),
        F.call_function("div", F.col("debit"), F.lit(200)).alias("itemised"), (F.col("seq") % 3 * 10_000).alias("employer_nps"),
        F.call_function("div", F.col("debit"), F.lit(300)).alias("rent_paid"),
        F.when(F.col("seq") % 4 != 0, F.col("seq") % 300_000).alias("hra_received"),
        F.when(F.col("seq") % 5 != 0, F.col("seq") % 700_000 + 100_001).alias("basic"),
        F.when(F.col("seq") % 2 == 0, "metro").otherwise("non_metro").alias("city_tier"),
    )


SQL_TAXPAYERS = """
taxpayers AS (SELECT own_account_id, fy_key, (credit * 5 // CASE seq % 9 WHEN 0 THEN 10 WHEN 1 THEN 200 ELSE 100 END)::BIGINT AS gross,
    (debit // 200)::BIGINT AS itemised, seq % 3 * 10000 AS employer_nps, (debit // 300)::BIGINT AS rent_paid,
    CASE WHEN seq % 4 <> 0 THEN seq % 300000 END AS hra_received, CASE WHEN seq % 5 <> 0 THEN seq % 700000 + 100001 END AS basic,
    CASE WHEN seq % 2 = 0 THEN 'metro' ELSE 'non_metro' END AS city_tier
  FROM (SELECT owner_id, own_account_id, fy_key, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END)::BIGINT AS credit,
    sum(CASE WHEN amount > 0 THEN 0 ELSE -amount END)::BIGINT AS debit, min(seq) AS seq FROM ledger_orders GROUP BY ALL))"""


def sql_slabs(regime: str) -> str:
    rows = ", ".join(f"({lo}, {hi if hi is not None else 'NULL'}, {rate}::DOUBLE)" for lo, hi, rate in fv.TAX_SLABS[regime])
    return f"{regime}_slabs(lo, hi, rate) AS (VALUES {rows})"


def sql_regime(regime: str, source: str, taxable: str, key: str = "own_account_id, fy_key") -> str:
    """Slab table join, then rebate, surcharge and cess, for one regime."""
    ceiling, largest, marginal = fv.TAX_REBATE[regime]
    above = f"CASE WHEN base > x - {ceiling} THEN base - (x - {ceiling}) ELSE 0 END" if marginal else "0"
    rate = "CASE " + " ".join(f"WHEN x > {over} THEN {value}::DOUBLE" for over, value in reversed(fv.TAX_SURCHARGE[regime])) + " ELSE 0::DOUBLE END"
    return f"""
{regime}_x AS (SELECT {key}, greatest(0, {taxable})::BIGINT AS x FROM {source}),
{regime}_base AS (SELECT {key}, x, sum(greatest(0, least(x, coalesce(hi, x)) - lo)::DOUBLE * rate ORDER BY lo) AS base FROM {regime}_x, {regime}_slabs GROUP BY ALL),
{regime}_r AS (SELECT *, CASE WHEN x <= {ceiling} THEN least(base, {largest}) ELSE {above} END AS rebate FROM {regime}_base),
{regime}_t AS (SELECT *, {b.sql_round('base - rebate')} AS tax FROM {regime}_r),
{regime}_s AS (SELECT *, {b.sql_round(f'tax * {rate}')} AS surcharge FROM {regime}_t),
{regime}_c AS (SELECT *, {b.sql_round('(tax + surcharge) * 0.04::DOUBLE')} AS cess FROM {regime}_s),
{regime}_out AS (SELECT {key}, x AS {regime}_taxable, tax AS {regime}_tax, rebate::DOUBLE AS {regime}_rebate, surcharge AS {regime}_surcharge,
  cess AS {regime}_cess, tax + surcharge + cess AS {regime}_total FROM {regime}_c)"""


OLD_X = f"gross - {fv.STANDARD_DEDUCTION['old']} - itemised"
NEW_X = f"gross - {fv.STANDARD_DEDUCTION['new']} - employer_nps"
VIEW = [f"{r}_{c}" for r in ("old", "new") for c in ("taxable", "tax", "surcharge", "cess", "total")]
VERDICT = "CASE WHEN old_total <= new_total THEN 'old' ELSE 'new' END AS recommended, abs(old_total - new_total) AS saving"


def on_taxpayers(select: str) -> str:
    return b.with_ctes(
        b.SQL_ORDERS, SQL_TAXPAYERS, sql_slabs("old"), sql_slabs("new"),
        sql_regime("old", "taxpayers", OLD_X), sql_regime("new", "taxpayers", NEW_X), select=select,
    )


@query("slab_tax", on_taxpayers("SELECT own_account_id, fy_key, o.base AS old_base, n.base AS new_base FROM old_base o JOIN new_base n USING (own_account_id, fy_key)"))
def slab_tax(spark, sf_dir):
    rows = taxpayers(spark, sf_dir)

    def taxable(reduced):
        return F.greatest(F.lit(0).cast("bigint"), F.col("gross") - reduced)

    return rows.select(
        "own_account_id", "fy_key",
        tax.slab_tax(taxable(fv.STANDARD_DEDUCTION["old"] + F.col("itemised")), "old").alias("old_base"),
        tax.slab_tax(taxable(fv.STANDARD_DEDUCTION["new"] + F.col("employer_nps")), "new").alias("new_base"),
    )


def regime_query(regime):
    columns = [f"{regime}_{c}" for c in ("taxable", "tax", "rebate", "surcharge", "cess", "total")]

    @query(f"regime_tax_{regime}", on_taxpayers(f"SELECT own_account_id, fy_key, {', '.join(columns)} FROM {regime}_out"))
    def run(spark, sf_dir):
        return tax.compare_regimes(taxpayers(spark, sf_dir)).select("own_account_id", "fy_key", *columns)


regime_query("old")
regime_query("new")


@query("compare_regimes", on_taxpayers(f"SELECT own_account_id, fy_key, {', '.join(VIEW)}, {VERDICT} FROM old_out JOIN new_out USING (own_account_id, fy_key)"))
def compare_regimes(spark, sf_dir):
    return tax.compare_regimes(taxpayers(spark, sf_dir)).select("own_account_id", "fy_key", *VIEW, "recommended", "saving")


@query(
    "hra_exemption",
    b.with_ctes(
        b.SQL_ORDERS, SQL_TAXPAYERS,
        select=f"""SELECT own_account_id, fy_key, CASE WHEN coalesce(hra_received, 0) <= 0 THEN 0
          WHEN coalesce(basic, 0) > 0 THEN greatest(0, {b.sql_round("least(hra_received::DOUBLE, rent_paid - basic * 0.1::DOUBLE, CASE WHEN city_tier = 'metro' THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END * basic)")})
          ELSE least(hra_received, rent_paid) END::BIGINT AS exemption FROM taxpayers""",
    ),
)
def hra_exemption(spark, sf_dir):
    claim = tax.hra_exemption(F.col("rent_paid"), F.col("hra_received"), F.col("basic"), F.col("city_tier"))
    return taxpayers(spark, sf_dir).select("own_account_id", "fy_key", claim.alias("exemption"))


def households(spark, sf_dir):
    c = b.table(spark, sf_dir, "customer")
    owner = F.floor(F.col("c_custkey") / b.ACCOUNTS_PER_OWNER).cast("bigint")
    return c.groupBy(owner.alias("owner_id")).agg(F.sum("c_nationkey").cast("bigint").alias("n")).select(
        "owner_id", F.when(F.col("owner_id") % 5 != 0, F.col("n") * 100).alias("hra_received"),
        F.when(F.col("owner_id") % 2 == 0, F.col("n") * 1000 + 7).alias("basic_salary"),
        F.when(F.col("owner_id") % 3 == 0, "metro").otherwise("non_metro").alias("city_tier"),
    )


def spelled(spark, sf_dir):
    """Line items whose Groceries tag stands for the rent allowance of every seventh owner."""
    tag = F.when((F.col("tax_section") == "other") & (F.col("owner_id") % 7 == 0), "hra").otherwise(F.col("tax_section"))
    return b.ledger_lines(spark, sf_dir).withColumn("tax_section", tag)


def sql_section(tag: str) -> str:
    return b.sql_case(f"lower({tag})", fv.SECTION_SPELLINGS)


SQL_DETECTED = f"""
households AS (SELECT owner_id, CASE WHEN owner_id % 5 <> 0 THEN n * 100 END AS hra_received, CASE WHEN owner_id % 2 = 0 THEN n * 1000 + 7 END AS basic,
    CASE WHEN owner_id % 3 = 0 THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END AS city
  FROM (SELECT CAST(floor(c_custkey / {b.ACCOUNTS_PER_OWNER}) AS BIGINT) AS owner_id, sum(c_nationkey)::BIGINT AS n FROM customer GROUP BY 1)),
spelled AS (SELECT * REPLACE (CASE WHEN tax_section = 'other' AND owner_id % 7 = 0 THEN 'hra' ELSE tax_section END AS tax_section) FROM ledger_lines),
tagged AS (SELECT owner_id, fy_key, {sql_section('tax_section')} AS section, {b.sql_major('sum(abs(amount))')} AS raw_amount, count(*)::BIGINT AS evidence
  FROM spelled WHERE {sql_section('tax_section')} IS NOT NULL GROUP BY owner_id, fy_key, tax_section),
rents AS (SELECT owner_id, fy_key, {b.sql_major('sum(abs(amount))')} AS rent, count(*)::BIGINT AS evidence FROM spelled
  WHERE flow = 'expense' AND lower(subcategory) = 'rent' AND (owner_id, fy_key) NOT IN (SELECT owner_id, fy_key FROM tagged WHERE section = 'HRA') GROUP BY owner_id, fy_key),
detected AS (SELECT * FROM tagged UNION ALL
  SELECT owner_id, fy_key, 'HRA', CASE WHEN coalesce(hra_received, 0) <= 0 THEN 0 ELSE least(hra_received, rent) END::BIGINT, evidence FROM rents LEFT JOIN households USING (owner_id)),
capped AS (SELECT *, CASE section WHEN '80C' THEN 150000 WHEN '80CCD(1B)' THEN 50000 WHEN '80D' THEN 75000 WHEN '24(b)' THEN 200000 END::BIGINT AS cap,
  least(raw_amount, coalesce(cap, raw_amount))::BIGINT AS amount FROM detected)"""


@query("deduction_caps", on_lines("SELECT owner_id, fy_key, section, raw_amount, evidence, cap, amount FROM capped", SQL_DETECTED))
def deduction_caps(spark, sf_dir):
    return tax.capped(tax.detected_sections(spelled(spark, sf_dir), households(spark, sf_dir)))


@query(
    "headroom",
    on_lines("SELECT owner_id, fy_key, section, raw_amount, evidence, cap, amount, greatest(cap - amount, 0)::BIGINT AS headroom, cap <= amount AS maxed FROM capped WHERE cap IS NOT NULL", SQL_DETECTED),
)
def headroom(spark, sf_dir):
    return tax.headroom(deduction_caps(spark, sf_dir))


@query(
    "tax_rollup",
    on_lines(
        f"SELECT owner_id, fy_key, gross, itemised, {', '.join(VIEW)}, {VERDICT} FROM payers JOIN old_out USING (owner_id, fy_key) JOIN new_out USING (owner_id, fy_key)",
        SQL_DETECTED,
        f"""payers AS (SELECT i.owner_id, i.fy_key, i.gross, coalesce(d.itemised, 0)::BIGINT AS itemised, 0 AS employer_nps
          FROM (SELECT owner_id, fy_key, sum({b.sql_major('amount')})::BIGINT AS gross FROM spelled WHERE {SQL_INCOME} AND fy_key IN ('{"', '".join(YEARS)}') GROUP BY ALL HAVING gross > 0) i
          LEFT JOIN (SELECT owner_id, fy_key, sum(amount) AS itemised FROM capped GROUP BY ALL) d USING (owner_id, fy_key))""",
        sql_slabs("old"), sql_slabs("new"),
        sql_regime("old", "payers", OLD_X, "owner_id, fy_key"), sql_regime("new", "payers", NEW_X, "owner_id, fy_key"),
    ),
)
def tax_rollup(spark, sf_dir):
    done = tax.tax_rollup(spelled(spark, sf_dir), households(spark, sf_dir), YEARS)
    return done.select("owner_id", "fy_key", "gross", "itemised", *VIEW, "recommended", "saving")
