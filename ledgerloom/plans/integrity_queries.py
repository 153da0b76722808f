"""Duplicates, recurrence, subscriptions and internal transfers over the bound ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import period, text
from ledgerloom.operators import dedup, recurrence, rules, transfers
from ledgerloom.plans import bindings as b
from ledgerloom.plans.registry import query
from ledgerloom.session import checkpointed
from ledgerloom.streaming import incremental

# ------------------------------------------------------------------ overlapping statements
ROW = ["owner_id", "txn_id", "document_id", "own_account_id", "txn_date", "amount", "raw_description", "seq"]


def statement_rows(spark, sf_dir):
    """Each order in its own statement, a third again in an annual one, some repeated in place."""
    base = b.ledger_orders(spark, sf_dir).select(*ROW)
    key = F.col("seq")
    annual = base.filter(key % 3 == 0).select(
        "owner_id",
        F.concat(F.lit("c"), key).alias("txn_id"),
        F.concat(F.lit("annual_"), F.col("own_account_id")).alias("document_id"),
        F.when(key % 15 != 0, F.col("own_account_id")).alias("own_account_id"),
        "txn_date", "amount",
        F.when(key % 6 == 0, F.concat("raw_description", F.lit(" autumn sale"))).otherwise(F.col("raw_description")).alias("raw_description"),
        (key + 1_000_000_000).alias("seq"),
    )
    third = base.filter(key % 12 == 0).select(
        "owner_id",
        F.concat(F.lit("e"), key).alias("txn_id"),
        F.concat(F.lit("extra_"), F.col("own_account_id")).alias("document_id"),
        "own_account_id", "txn_date", "amount",
        F.concat("raw_description", F.lit(" autumn")).alias("raw_description"),
        (key + 2_000_000_000).alias("seq"),
    )
    repeat = base.filter(key % 7 == 0).withColumns(
        {"txn_id": F.concat(F.lit("r"), key), "seq": key + 500_000_000}
    )
    return base.unionByName(annual).unionByName(third).unionByName(repeat)


def is_stored():
    return F.pmod(F.col("seq"), F.lit(5)) == 0


SQL_STATEMENTS = f"""
base AS (SELECT {', '.join(ROW)} FROM ledger_orders),
statement_rows AS (
  SELECT * FROM base
  UNION ALL SELECT owner_id, 'c' || seq, 'annual_' || own_account_id, CASE WHEN seq % 15 <> 0 THEN own_account_id END, txn_date, amount,
    raw_description || CASE WHEN seq % 6 = 0 THEN ' autumn sale' ELSE '' END, seq + 1000000000 FROM base WHERE seq % 3 = 0
  UNION ALL SELECT owner_id, 'e' || seq, 'extra_' || own_account_id, own_account_id, txn_date, amount,
    raw_description || ' autumn', seq + 2000000000 FROM base WHERE seq % 12 = 0
  UNION ALL SELECT owner_id, 'r' || seq, document_id, own_account_id, txn_date, amount, raw_description, seq + 500000000 FROM base WHERE seq % 7 = 0),
keyed AS (SELECT *, {b.sql_signature('raw_description')} AS signature, coalesce(own_account_id, '') AS account_key FROM statement_rows)"""
KEY = "owner_id, txn_date, amount, signature, account_key"


def on_statements(select: str, *ctes: str) -> str:
    return b.with_ctes(b.SQL_ORDERS, SQL_STATEMENTS, *ctes, select=select)


@query("signature", on_statements("SELECT txn_id, signature FROM keyed"))
def signature(spark, sf_dir):
    return dedup.with_key(statement_rows(spark, sf_dir)).select("txn_id", "signature")


@query("signature_text", f"SELECT doc_id, {b.sql_clean('text')} AS cleaned, {b.sql_signature('text')} AS signature FROM documents")
def signature_text(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.clean(F.col("text")).alias("cleaned"), text.signature(F.col("text")).alias("signature"))


@query(
    "dedup_key",
    on_statements("SELECT txn_id, txn_date::VARCHAR || '|' || amount || '|' || signature || '|' || account_key AS dedup_key FROM keyed"),
)
def dedup_key(spark, sf_dir):
    rows = dedup.with_key(statement_rows(spark, sf_dir))
    return rows.select("txn_id", dedup.key_text(rows).alias("dedup_key"))


SQL_MARKED = f"""
marked AS (
  SELECT k.*, (s.known IS NULL AND document_id = first_value(document_id) OVER (PARTITION BY {', '.join('k.' + c.strip() for c in KEY.split(','))} ORDER BY seq, txn_id)) AS kept
  FROM keyed k LEFT JOIN (SELECT DISTINCT {KEY}, true AS known FROM keyed WHERE seq % 5 = 0) s USING ({KEY})
  WHERE seq % 5 <> 0)"""


@query("dedup_cross_doc", on_statements("SELECT txn_id, document_id, kept FROM marked", SQL_MARKED))
def dedup_cross_doc(spark, sf_dir):
    rows = statement_rows(spark, sf_dir)
    marked = dedup.mark_duplicates(rows.filter(~is_stored()), rows.filter(is_stored()))
    return marked.select("txn_id", "document_id", "kept")


SQL_INGESTED = f"""
first_kept AS (
  SELECT * FROM (SELECT *, first_value(document_id) OVER (PARTITION BY {KEY} ORDER BY seq, txn_id) AS claimer FROM keyed WHERE seq % 2 = 0)
  WHERE document_id = claimer),
second_kept AS (
  SELECT * FROM (SELECT *, first_value(document_id) OVER (PARTITION BY {KEY} ORDER BY seq, txn_id) AS claimer FROM keyed WHERE seq % 2 = 1) k
  WHERE document_id = claimer AND NOT EXISTS (SELECT 1 FROM first_kept f WHERE {' AND '.join(f'f.{c.strip()} = k.{c.strip()}' for c in KEY.split(','))} AND f.document_id <> k.document_id))"""


@query(
    "incremental_ingest",
    on_statements(
        "SELECT owner_id, txn_id, document_id, amount FROM first_kept UNION ALL SELECT owner_id, txn_id, document_id, amount FROM second_kept", SQL_INGESTED
    ),
)
def incremental_ingest(spark, sf_dir):
    """Statements whose rows arrive in two batches, most documents in both, through the batch functions of the stream."""
    landed = statement_rows(spark, sf_dir).withColumns(
        {
            "own_account_kind": F.lit("bank"), "institution_id": F.lit("i"), "currency": F.lit("INR"), "counterparty_raw": F.lit(None).cast("string"),
            "fy_key": period.fy_key(F.col("txn_date")), "parse_id": F.lit(1).cast("bigint"),
        }
    )
    nothing = incremental.Knowledge(
        profiles=lambda s: s.createDataFrame([], rules.PROFILE_SCHEMA),
        overrides=lambda s: s.createDataFrame(
            [], "owner_id bigint, match_signature string, seq int, flow string, category string, subcategory string, merchant string, tax_section string, note string"
        ),
        aliases=lambda s: s.createDataFrame(
            [], "pattern string, canonical_merchant string, category string, subcategory string, source string, confidence string, seq int"
        ),
        counterparties=lambda s: s.createDataFrame(
            [], "owner_id bigint, entries array<struct<id:string,kind:string,is_own_money:boolean,vpa_fragments:array<string>,name_tokens:array<string>,last4:array<string>>>"
        ),
    )
    even = F.col("seq") % 2 == 0
    first = checkpointed(incremental.ingest(landed.filter(even), landed.limit(0), nothing))
    second = incremental.ingest(landed.filter(~even), first, nothing)
    return incremental.current_rows(first.unionByName(second)).select("owner_id", "txn_id", "document_id", "amount")


@query(
    "dedup_counts",
    on_statements(
        "SELECT owner_id, count(*) FILTER (WHERE kept)::BIGINT AS kept, count(*) FILTER (WHERE NOT kept)::BIGINT AS dropped FROM marked GROUP BY 1",
        SQL_MARKED,
    ),
)
def dedup_counts(spark, sf_dir):
    rows = statement_rows(spark, sf_dir)
    marked = dedup.mark_duplicates(rows.filter(~is_stored()), rows.filter(is_stored()))
    return marked.groupBy("owner_id").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


@query(
    "first_claimer",
    on_statements(f"SELECT {KEY}, arg_min(document_id, (seq, txn_id)) AS claimer FROM keyed GROUP BY {KEY}"),
)
def first_claimer(spark, sf_dir):
    rows = dedup.with_key(statement_rows(spark, sf_dir))
    return rows.groupBy(*dedup.KEY).agg(F.min_by("doc_key", F.struct("seq", "txn_id")).alias("claimer"))


@query(
    "dedup_history",
    on_statements(
        f"""SELECT txn_id, document_id, keeper_doc FROM (SELECT *, first_value(document_id) OVER (PARTITION BY {KEY} ORDER BY seq, txn_id) AS keeper_doc
        FROM keyed) WHERE document_id <> keeper_doc"""
    ),
)
def dedup_history(spark, sf_dir):
    return dedup.historical_excess(statement_rows(spark, sf_dir)).select("txn_id", "document_id", "keeper_doc")


def sql_pairs(stored: str, incoming: str) -> str:
    # ranks put stored rows before incoming ones; the oracle compares every pair of a place
    return f"""
ranked AS (SELECT *, CASE WHEN {stored} THEN 0 ELSE 1 END AS phase FROM keyed WHERE own_account_id IS NOT NULL AND signature <> ''),
pairs AS (
  SELECT c.owner_id, 'dup_' || c.txn_id AS duplicate_id,
    arg_min(p.txn_id, (p.phase, p.seq, p.txn_id)) AS keeper_txn_id, c.txn_id AS candidate_txn_id, 'signature_token_prefix' AS basis
  FROM ranked c JOIN ranked p ON p.owner_id = c.owner_id AND p.own_account_id = c.own_account_id AND p.txn_date = c.txn_date
    AND p.amount = c.amount AND p.document_id <> c.document_id AND (p.phase, p.seq, p.txn_id) < (c.phase, c.seq, c.txn_id)
    AND (starts_with(p.signature, c.signature || ' ') OR starts_with(c.signature, p.signature || ' '))
  WHERE {incoming} GROUP BY c.owner_id, c.txn_id)"""


@query("suspected_dups", on_statements("SELECT * FROM pairs", sql_pairs("seq % 5 = 0", "c.phase = 1")))
def suspected_dups(spark, sf_dir):
    rows = statement_rows(spark, sf_dir)
    return dedup.suspected_pairs(rows.filter(is_stored()), rows.filter(~is_stored()))


SQL_DECISIONS = """
decisions AS (SELECT owner_id, 'dup_' || txn_id AS duplicate_id, txn_id AS candidate_txn_id,
  CASE WHEN seq % 4 = 0 THEN 'kept' WHEN seq % 4 = 1 THEN 'removed' ELSE 'open' END AS status
  FROM keyed WHERE seq % 9 = 0)"""


def duplicate_decisions(spark, sf_dir):
    rows = statement_rows(spark, sf_dir).filter("seq % 9 = 0")
    four = F.col("seq") % 4
    return rows.select(
        "owner_id", F.concat(F.lit("dup_"), F.col("txn_id")).alias("duplicate_id"), F.col("txn_id").alias("candidate_txn_id"),
        F.when(four == 0, "kept").when(four == 1, "removed").otherwise("open").alias("status"),
    )


@query(
    "dup_cleanup_plan",
    on_statements(
        """SELECT p.*, EXISTS (SELECT 1 FROM decisions d WHERE d.owner_id = p.owner_id AND d.candidate_txn_id = p.candidate_txn_id AND d.status = 'kept') AS skipped
        FROM pairs p""",
        sql_pairs("false", "true"),
        SQL_DECISIONS,
    ),
)
def dup_cleanup_plan(spark, sf_dir):
    return dedup.cleanup_plan(statement_rows(spark, sf_dir), duplicate_decisions(spark, sf_dir))


@query(
    "dup_cleanup_apply",
    on_statements(
        """SELECT owner_id, txn_id, document_id FROM keyed k WHERE NOT EXISTS (
        SELECT 1 FROM pairs p WHERE p.owner_id = k.owner_id AND p.candidate_txn_id = k.txn_id
          AND NOT EXISTS (SELECT 1 FROM decisions d WHERE d.owner_id = p.owner_id AND d.candidate_txn_id = p.candidate_txn_id AND d.status = 'kept'))""",
        sql_pairs("false", "true"),
        SQL_DECISIONS,
    ),
)
def dup_cleanup_apply(spark, sf_dir):
    rows = statement_rows(spark, sf_dir)
    plan = dedup.cleanup_plan(rows, duplicate_decisions(spark, sf_dir)).filter("not skipped")
    gone = plan.select("owner_id", F.col("candidate_txn_id").alias("txn_id"))
    return rows.join(gone, ["owner_id", "txn_id"], "left_anti").select("owner_id", "txn_id", "document_id")


@query(
    "dup_decisions",
    on_statements(
        """SELECT duplicate_id, CASE WHEN status = 'open' AND k.seq % 2 = 0 THEN 'kept' ELSE status END AS status FROM (
          SELECT duplicate_id, candidate_txn_id, status FROM decisions
          UNION ALL SELECT duplicate_id, candidate_txn_id, 'open' FROM pairs WHERE duplicate_id NOT IN (SELECT duplicate_id FROM decisions)) d
        JOIN keyed k ON k.txn_id = d.candidate_txn_id""",
        sql_pairs("seq % 5 = 0", "c.phase = 1"),
        SQL_DECISIONS,
    ),
)
def dup_decisions(spark, sf_dir):
    rows = statement_rows(spark, sf_dir)
    pairs = dedup.suspected_pairs(rows.filter(is_stored()), rows.filter(~is_stored()))
    choices = rows.filter("seq % 2 = 0").select(F.concat(F.lit("dup_"), F.col("txn_id")).alias("duplicate_id"), F.lit("kept").alias("choice"))
    recorded = dedup.record_decisions(duplicate_decisions(spark, sf_dir), pairs)
    return dedup.decide(recorded, choices).select("duplicate_id", "status")


@query(
    "token_prefix",
    on_statements(
        """SELECT a.txn_id, b.txn_id AS other_txn_id, starts_with(b.signature, a.signature || ' ') OR starts_with(a.signature, b.signature || ' ') AS is_prefix
        FROM keyed a JOIN keyed b ON b.txn_id = 'c' || substr(a.txn_id, 2) WHERE a.txn_id LIKE 'o%'"""
    ),
)
def token_prefix(spark, sf_dir):
    rows = dedup.with_key(statement_rows(spark, sf_dir))
    originals = rows.filter(F.col("txn_id").startswith("o")).select("txn_id", "signature")
    copies = rows.filter(F.col("txn_id").startswith("c")).select(
        F.concat(F.lit("o"), F.substr("txn_id", F.lit(2))).alias("txn_id"),
        F.col("txn_id").alias("other_txn_id"), F.col("signature").alias("other"),
    )
    test = text.is_token_prefix(F.col("signature"), F.col("other"))
    return originals.join(copies, "txn_id").select("txn_id", "other_txn_id", test.alias("is_prefix"))


# -------------------------------------------------------------- recurrence, subscriptions
def charges(spark, sf_dir):
    """Orders as classified charges: even accounts are a known merchant, odd ones a descriptor."""
    orders = b.ledger_orders(spark, sf_dir)
    account = F.substr("own_account_id", F.lit(5)).cast("bigint")
    known = account % 2 == 0
    scale = F.when(account % 10 == 1, F.lit(20_000)).otherwise(F.lit(100))
    return orders.withColumns(
        {
            "amount": F.call_function("div", F.col("amount"), scale),
            "flow": F.when(F.col("amount") < 0, "expense").otherwise("income"),
            "merchant": F.when(known, F.concat(F.lit("Shop "), F.col("own_account_id"))),
            "category": F.when(known, "Ott").when(account % 3 == 0, "Housing").otherwise("Subscriptions"),
            "layer": F.when(account % 8 == 0, 5).otherwise(4),
            "is_internal_transfer": F.col("seq") % 50 == 0,
        }
    )


SQL_CHARGES = f"""
charges AS (
  SELECT * REPLACE (CAST(trunc(amount / CASE WHEN acc % 10 = 1 THEN 20000 ELSE 100 END) AS BIGINT) AS amount),
    CASE WHEN amount < 0 THEN 'expense' ELSE 'income' END AS flow,
    CASE WHEN acc % 2 = 0 THEN 'Shop ' || own_account_id END AS merchant,
    CASE WHEN acc % 2 = 0 THEN 'Ott' WHEN acc % 3 = 0 THEN 'Housing' ELSE 'Subscriptions' END AS category,
    CASE WHEN acc % 8 = 0 THEN 5 ELSE 4 END AS layer, seq % 50 = 0 AS is_internal_transfer,
    {b.sql_signature('raw_description')} AS signature
  FROM (SELECT *, substr(own_account_id, 5)::BIGINT AS acc FROM ledger_orders))"""


def sql_upper_median(value: str) -> str:
    return f"CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC) AS BIGINT)"


def sql_band(gap: str, bands) -> str:
    return "CASE " + " ".join(f"WHEN {gap} BETWEEN {lo} AND {hi} THEN '{name}'" for name, lo, hi in bands) + " END"


SQL_GAPS = """
gaps AS (SELECT owner_id, signature, txn_date, txn_id,
  date_diff('day', lag(txn_date) OVER (PARTITION BY owner_id, signature ORDER BY txn_date, txn_id), txn_date) AS gap, amount
  FROM charges WHERE amount < 0 AND signature <> '')"""


def on_charges(select: str, *ctes: str) -> str:
    return b.with_ctes(b.SQL_ORDERS, SQL_CHARGES, *ctes, select=select)


GROUP = ["owner_id", "signature"]


def signed_debits(spark, sf_dir):
    return charges(spark, sf_dir).filter("amount < 0").withColumn("signature", text.signature(F.col("raw_description")))


@query("gap_days", on_charges("SELECT owner_id, signature, gap::INT AS gap, count(*)::BIGINT AS times FROM gaps WHERE gap IS NOT NULL GROUP BY ALL", SQL_GAPS))
def gap_days(spark, sf_dir):
    return recurrence.gap_rows(signed_debits(spark, sf_dir), GROUP)


@query("upper_median", on_charges(f"SELECT owner_id, signature, {sql_upper_median('gap')}::INT AS median_gap FROM gaps WHERE gap IS NOT NULL GROUP BY ALL", SQL_GAPS))
def upper_median(spark, sf_dir):
    return recurrence.upper_median_gap(signed_debits(spark, sf_dir), GROUP)


@query(
    "latest_value",
    on_charges("SELECT owner_id, signature, arg_max(amount, (txn_date, txn_id)) AS amount FROM charges WHERE amount < 0 GROUP BY ALL"),
)
def latest_value(spark, sf_dir):
    return signed_debits(spark, sf_dir).groupBy(*GROUP).agg(F.max_by("amount", F.struct("txn_date", "txn_id")).alias("amount"))


@query(
    "first_last_seen",
    on_charges("SELECT owner_id, signature, min(txn_date) AS first_seen, max(txn_date) AS last_seen, count(*)::BIGINT AS occurrences FROM charges WHERE amount < 0 GROUP BY ALL"),
)
def first_last_seen(spark, sf_dir):
    return signed_debits(spark, sf_dir).groupBy(*GROUP).agg(
        F.min("txn_date").alias("first_seen"), F.max("txn_date").alias("last_seen"), F.count("*").alias("occurrences")
    )


SQL_INDEX = f"""
recurring AS (SELECT owner_id, signature, cadence, occurrences FROM (
  SELECT owner_id, signature, count(*)::BIGINT AS occurrences, {sql_upper_median('abs(amount)')} AS median_amount,
    {sql_band(sql_upper_median('gap'), fv.RECURRENCE_BANDS)} AS cadence
  FROM gaps WHERE NOT regexp_matches(signature, '{fv.STRUCTURAL_RECURRENCE_PATTERN}') GROUP BY ALL)
  WHERE occurrences >= 3 AND median_amount <= 2500000 AND cadence IS NOT NULL)"""


@query("recurrence_index", on_charges("SELECT * FROM recurring", SQL_GAPS, SQL_INDEX))
def recurrence_index(spark, sf_dir):
    return recurrence.recurrence_index(charges(spark, sf_dir))


@query(
    "recurrence_equi",
    on_charges(
        "SELECT c.txn_id, r.cadence, r.occurrences FROM charges c LEFT JOIN recurring r ON r.owner_id = c.owner_id AND r.signature = c.signature AND c.amount < 0",
        SQL_GAPS,
        SQL_INDEX,
    ),
)
def recurrence_equi(spark, sf_dir):
    index = recurrence.recurrence_index(charges(spark, sf_dir))
    rows = charges(spark, sf_dir).withColumn("signature", F.when(F.col("amount") < 0, text.signature(F.col("raw_description"))))
    return rows.join(index, GROUP, "left").select("txn_id", "cadence", "occurrences")


SQL_CANDIDATES = """
candidates AS (SELECT *, CASE WHEN category = 'Ott' AND layer <= 4 THEN 'm:' || lower(merchant)
    WHEN category = 'Subscriptions' THEN 's:' || signature END AS subscription_key,
    category = 'Ott' AND layer <= 4 AS known
  FROM charges WHERE flow = 'expense' AND NOT is_internal_transfer AND amount < 0 AND category <> 'Housing')"""


@query(
    "subscription_candidates",
    on_charges("SELECT txn_id, subscription_key, known FROM candidates WHERE subscription_key IS NOT NULL", SQL_CANDIDATES),
)
def subscription_candidates(spark, sf_dir):
    return recurrence.subscription_candidates(charges(spark, sf_dir)).select("txn_id", "subscription_key", "known")


SQL_SUBSCRIPTIONS = f"""
subscriptions AS (
  SELECT owner_id, 'sub_' || {b.sql_capped("trim(regexp_replace(subscription_key, '[^a-z0-9]+', '-', 'g'), '-')", 48)} AS subscription_id,
    CASE WHEN known THEN label END AS known_merchant, amount, cadence, CASE WHEN known THEN 'confirmed' ELSE 'likely' END AS status,
    first_seen, last_seen, occurrences, category,
    CASE cadence WHEN 'monthly' THEN last_seen + INTERVAL 1 MONTH WHEN 'quarterly' THEN last_seen + INTERVAL 3 MONTH ELSE last_seen + INTERVAL 12 MONTH END::DATE AS next_charge
  FROM (SELECT * REPLACE (coalesce(cadence, CASE WHEN occurrences = 1 AND amount >= 120000 THEN 'yearly' ELSE 'monthly' END) AS cadence) FROM (
    SELECT owner_id, subscription_key, known, count(*)::BIGINT AS occurrences, min(txn_date) AS first_seen, max(txn_date) AS last_seen,
      arg_max(abs(amount), (txn_date, txn_id)) AS amount, arg_min(merchant, (txn_date, txn_id)) AS label, min(category) AS category,
      {sql_upper_median('abs(amount)')} AS median_amount, {sql_band(sql_upper_median('gap'), fv.SUBSCRIPTION_BANDS)} AS cadence
    FROM (SELECT *, date_diff('day', lag(txn_date) OVER (PARTITION BY owner_id, subscription_key ORDER BY txn_date, txn_id), txn_date) AS gap
          FROM candidates WHERE subscription_key IS NOT NULL AND NOT suffix(subscription_key, ':'))
    GROUP BY ALL) WHERE known OR (occurrences >= 3 AND cadence IS NOT NULL AND median_amount >= 3000)))"""


@query("subscriptions", on_charges("SELECT * FROM subscriptions", SQL_CANDIDATES, SQL_SUBSCRIPTIONS))
def subscriptions(spark, sf_dir):
    # an unknown label comes from a look-ahead pattern the oracle cannot express; its test is in tests/
    found = recurrence.detect_subscriptions(charges(spark, sf_dir))
    known = F.when(F.col("status") == "confirmed", F.col("merchant"))
    return found.withColumn("known_merchant", known).drop("merchant")


@query("subscription_labels")
def subscription_labels(spark, sf_dir):
    return recurrence.detect_subscriptions(charges(spark, sf_dir)).select("owner_id", "subscription_id", "merchant")


SQL_STATUS = """
restated AS (SELECT s.* REPLACE (CASE WHEN hash_id % 3 = 0 THEN 'dismissed' ELSE status END AS status)
  FROM (SELECT *, length(subscription_id) + occurrences AS hash_id FROM subscriptions) s)"""


def previous_statuses(spark, sf_dir):
    earlier = recurrence.detect_subscriptions(charges(spark, sf_dir))
    chosen = (F.length("subscription_id") + F.col("occurrences")) % 3 == 0
    return earlier.filter(chosen).select("owner_id", "subscription_id", F.lit("dismissed").alias("status"))


@query("subscription_status", on_charges("SELECT owner_id, subscription_id, status FROM restated", SQL_CANDIDATES, SQL_SUBSCRIPTIONS, SQL_STATUS))
def subscription_status(spark, sf_dir):
    found = recurrence.detect_subscriptions(charges(spark, sf_dir), previous_statuses(spark, sf_dir))
    return found.select("owner_id", "subscription_id", "status")


@query("subscription_patch", on_charges("SELECT owner_id, subscription_id, status FROM restated", SQL_CANDIDATES, SQL_SUBSCRIPTIONS, SQL_STATUS))
def subscription_patch(spark, sf_dir):
    changes = previous_statuses(spark, sf_dir).withColumnRenamed("status", "new_status")
    patched = recurrence.set_status(recurrence.detect_subscriptions(charges(spark, sf_dir)), changes)
    return patched.select("owner_id", "subscription_id", "status")


SQL_ANNUAL = f"""
annual AS (SELECT *, {b.sql_major('amount')} AS amount_major,
  ({b.sql_major('amount')} * CASE cadence WHEN 'monthly' THEN 12 WHEN 'quarterly' THEN 4 ELSE 1 END)::BIGINT AS annual FROM subscriptions)"""


@query(
    "subscription_rollup",
    on_charges("SELECT owner_id, subscription_id, amount_major, annual, cadence FROM annual", SQL_CANDIDATES, SQL_SUBSCRIPTIONS, SQL_ANNUAL),
)
def subscription_rollup(spark, sf_dir):
    rolled = recurrence.annual_cost(recurrence.detect_subscriptions(charges(spark, sf_dir)))
    return rolled.select("owner_id", "subscription_id", "amount_major", "annual", "cadence")


@query(
    "subscription_totals",
    on_charges(
        f"""SELECT owner_id, sum(annual)::BIGINT AS annual_total, {b.sql_round('sum(annual) / 12.0')} AS monthly_equivalent,
        arg_min(subscription_id, (next_charge, subscription_id)) FILTER (WHERE next_charge >= DATE '2001-01-01') AS next_subscription_id,
        min(next_charge) FILTER (WHERE next_charge >= DATE '2001-01-01') AS next_charge
        FROM annual WHERE status = 'confirmed' GROUP BY owner_id""",
        SQL_CANDIDATES,
        SQL_SUBSCRIPTIONS,
        SQL_ANNUAL,
    ),
)
def subscription_totals(spark, sf_dir):
    return recurrence.totals(recurrence.detect_subscriptions(charges(spark, sf_dir)), F.lit("2001-01-01").cast("date"))


# ------------------------------------------------------------------------------ transfers
DESCRIPTIONS = [
    "NEFT transfer to own account", "card payment received", "AUTOPAY towards my card bill", "corner store",
    "lunch with friends", "IMPS self", "BIL/ONL/123/BILL  DESK/CRED_ab1/MKS-9", "monthly salary",
]
OWN_NAMES = ["lu", "lunch"]


def event_legs(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    key, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    large = key % 37 == 0
    size = F.when(large, (F.floor(F.col("value") / 50) + 10) * 1_000_000).otherwise((F.floor(F.col("value") / 5) + 1) * 500)
    debit = kind.isin("purchase", "view") | ((kind == "error") & (key % 2 == 0))
    amount = (size * F.when(debit, -1).otherwise(1)).cast("bigint")
    date = F.to_date("ts")
    return e.select(
        F.floor(user / 10).cast("bigint").alias("owner_id"),
        F.concat(F.lit("e"), key).alias("txn_id"),
        F.when(key % 29 != 0, F.concat_ws("_", F.lit("d"), user, F.floor(F.dayofmonth(date) / 7))).alias("document_id"),
        F.when(key % 13 != 0, F.concat(F.lit("acc_"), user)).alias("own_account_id"),
        date.alias("txn_date"),
        amount.alias("amount"),
        F.get(F.array(*[F.lit(d) for d in DESCRIPTIONS]), (key % 8).cast("int")).alias("raw_description"),
        F.when(key % 3 == 0, F.concat(F.lit("Shop "), user)).alias("merchant"),
        F.when(key % 11 == 0, "transfer").when(debit, "expense").otherwise("income").alias("flow"),
        F.when(key % 17 == 0, "own_account").when(key % 17 == 1, "external").when(key % 17 == 2, "known_own")
        .when(key % 17 != 3, "unknown").alias("counterparty_kind"),
        (key % 19 == 0).alias("is_internal_transfer"),
        (key % 23 == 0).alias("suspected_transfer"),
        (key % 5 == 0).alias("review_required"),
        F.lit("Misc").alias("category"),
        F.lit("rule").alias("reason"),
    )


SQL_LEGS = f"""
legs AS (
  SELECT *, abs(amount) AS abs_amount, CASE WHEN amount < 0 THEN 'debit' ELSE 'credit' END AS side,
    coalesce(document_id, '') AS doc_key, coalesce(own_account_id, '') AS account_key,
    own_account_id IS NOT NULL AND merchant IS NULL AS bare,
    coalesce(flow = 'transfer', false) OR coalesce(counterparty_kind IN ('own_account', 'known_own'), false)
      OR regexp_matches(raw_description, '(?i){fv.TRANSFER_PATTERN}') OR regexp_matches(raw_description, '(?i){fv.CARD_AUTOPAY_PATTERN}')
      OR contains(lower(raw_description), 'lunch') AS explicit,
    regexp_matches(raw_description, '(?i){fv.CARD_BILL_PATTERN}') OR regexp_matches(raw_description, '(?i){fv.CARD_AUTOPAY_PATTERN}')
      OR regexp_matches(raw_description, '(?i){fv.CARD_BILL_RAIL_PATTERN}') AS card_bill,
    regexp_matches(raw_description, '(?i)\\bpayment received\\b') AS payment_received,
    coalesce(counterparty_kind IN ('own_account', 'known_own'), false) AS own_party
  FROM (SELECT CAST(floor(user_id / 10) AS BIGINT) AS owner_id, 'e' || event_id AS txn_id,
    CASE WHEN event_id % 29 <> 0 THEN 'd_' || user_id || '_' || floor(day(ts) / 7)::INT END AS document_id,
    CASE WHEN event_id % 13 <> 0 THEN 'acc_' || user_id END AS own_account_id, ts::DATE AS txn_date,
    (CASE WHEN event_id % 37 = 0 THEN (floor(value / 50) + 10) * 1000000 ELSE (floor(value / 5) + 1) * 500 END
     * CASE WHEN event_type IN ('purchase', 'view') OR (event_type = 'error' AND event_id % 2 = 0) THEN -1 ELSE 1 END)::BIGINT AS amount,
    {DESCRIPTIONS!r}[event_id % 8 + 1] AS raw_description,
    CASE WHEN event_id % 3 = 0 THEN 'Shop ' || user_id END AS merchant,
    CASE WHEN event_id % 11 = 0 THEN 'transfer' WHEN event_type IN ('purchase', 'view') OR (event_type = 'error' AND event_id % 2 = 0) THEN 'expense' ELSE 'income' END AS flow,
    CASE event_id % 17 WHEN 0 THEN 'own_account' WHEN 1 THEN 'external' WHEN 2 THEN 'known_own' WHEN 3 THEN NULL ELSE 'unknown' END AS counterparty_kind,
    event_id % 19 = 0 AS is_internal_transfer, event_id % 23 = 0 AS suspected_transfer, event_id % 5 = 0 AS review_required
    FROM events))"""

LEG_ORDER = "txn_date, doc_key, account_key, explicit, bare, txn_id"
SQL_COMPATIBLE = """abs(date_diff('day', c.txn_date, d.txn_date)) <= 4
  AND NOT (d.doc_key <> '' AND d.doc_key = c.doc_key)
  AND ((d.explicit AND c.explicit) OR (d.bare AND c.bare AND d.account_key <> c.account_key))"""
# serial greedy, one debit of every (owner, amount) per step, carrying the used credits
SQL_PAIRS = f"""
d AS (SELECT *, row_number() OVER (PARTITION BY owner_id, abs_amount ORDER BY {LEG_ORDER}) AS k FROM legs WHERE side = 'debit' AND (explicit OR bare)),
c AS (SELECT *, row_number() OVER (PARTITION BY owner_id, abs_amount ORDER BY {LEG_ORDER}) AS k FROM legs WHERE side = 'credit' AND (explicit OR bare)),
walk AS (
  SELECT DISTINCT owner_id, abs_amount, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::VARCHAR AS debit_txn_id, NULL::BIGINT AS taken FROM d
  UNION ALL
  SELECT s.owner_id, s.abs_amount, s.k, CASE WHEN s.taken IS NULL THEN s.used ELSE list_append(s.used, s.taken) END, s.txn_id, s.taken
  FROM (SELECT w.owner_id, w.abs_amount, w.used, d.k, d.txn_id, min(c.k) AS taken
        FROM walk w JOIN d ON d.owner_id = w.owner_id AND d.abs_amount = w.abs_amount AND d.k = w.k + 1
        LEFT JOIN c ON c.owner_id = w.owner_id AND c.abs_amount = w.abs_amount AND NOT list_contains(w.used, c.k) AND {SQL_COMPATIBLE}
        GROUP BY ALL) s),
pairs AS (SELECT walk.owner_id, walk.debit_txn_id, c.txn_id AS credit_txn_id FROM walk
  JOIN c ON c.owner_id = walk.owner_id AND c.abs_amount = walk.abs_amount AND c.k = walk.taken),
paired AS (SELECT owner_id, debit_txn_id AS txn_id, credit_txn_id AS other_txn_id FROM pairs UNION ALL SELECT owner_id, credit_txn_id, debit_txn_id FROM pairs),
linked AS (SELECT *, (NOT is_transfer AND amount >= 10000000 AND amount % 1000000 = 0 AND merchant IS NULL
    AND coalesce(counterparty_kind, 'unknown') = 'unknown') AS suspected
  FROM (SELECT legs.*, p.other_txn_id, p.other_txn_id IS NOT NULL OR own_party
      OR ((explicit OR account_key <> '') AND ((side = 'debit' AND card_bill) OR (side = 'credit' AND payment_received))) AS is_transfer
    FROM legs LEFT JOIN paired p USING (owner_id, txn_id)))"""


def on_legs(select: str, *ctes: str) -> str:
    return b.with_ctes(SQL_LEGS, *ctes, select=select).replace("WITH ", "WITH RECURSIVE ", 1)


def own_names():
    return F.array(*[F.lit(n) for n in OWN_NAMES])


def linked_legs(spark, sf_dir):
    return transfers.link_transfers(event_legs(spark, sf_dir), own_names())


FLAGS = "txn_id, explicit, (explicit OR account_key <> '') AS candidate, card_bill, payment_received, own_party, bare"


@query("transfer_flags", on_legs(f"SELECT {FLAGS} FROM legs"))
def transfer_flags(spark, sf_dir):
    flagged = transfers.with_flags(event_legs(spark, sf_dir), own_names())
    return flagged.select("txn_id", "explicit", "candidate", "card_bill", "payment_received", "own_party", "bare")


@query("transfer_pairs", on_legs("SELECT * FROM pairs", SQL_PAIRS))
def transfer_pairs(spark, sf_dir):
    return transfers.transfer_pairs(transfers.with_flags(event_legs(spark, sf_dir), own_names()))


@query("transfer_pairs_next_day", on_legs("SELECT * FROM pairs", SQL_PAIRS.replace("d.txn_date)) <= 4", "d.txn_date)) <= 1")))
def transfer_pairs_next_day(spark, sf_dir):
    """Pairs under a window of one day."""
    return transfers.transfer_pairs(transfers.with_flags(event_legs(spark, sf_dir), own_names()), window_days=1)


@query(
    "transfer_links",
    on_legs(
        f"""SELECT {b.sql_capped("'lnk_' || debit_txn_id || '_' || credit_txn_id", 80)} AS link_id, p.owner_id, debit_txn_id, credit_txn_id,
        CASE WHEN d.card_bill OR c.card_bill THEN 'cc_payment' ELSE 'account_transfer' END AS kind, 'high' AS confidence
        FROM pairs p JOIN legs d ON d.txn_id = debit_txn_id JOIN legs c ON c.txn_id = credit_txn_id""",
        SQL_PAIRS,
    ),
)
def transfer_links(spark, sf_dir):
    return transfers.links_of(linked_legs(spark, sf_dir))


@query("transfer_single", on_legs("SELECT txn_id FROM linked WHERE is_transfer AND other_txn_id IS NULL", SQL_PAIRS))
def transfer_single(spark, sf_dir):
    return linked_legs(spark, sf_dir).filter("is_transfer and other_txn_id is null").select("txn_id")


@query("suspected_transfers", on_legs("SELECT txn_id, amount FROM linked WHERE suspected", SQL_PAIRS))
def suspected_transfers(spark, sf_dir):
    return linked_legs(spark, sf_dir).filter("suspected").select("txn_id", "amount")


@query(
    "relink_ledger",
    on_legs(
        """SELECT txn_id, CASE WHEN newly THEN 'transfer' ELSE flow END AS flow, CASE WHEN newly THEN 'Transfer' ELSE 'Misc' END AS category,
        CASE WHEN newly THEN false WHEN newly_suspected THEN true ELSE suspected_transfer END AS suspected_transfer,
        CASE WHEN newly THEN false WHEN newly_suspected THEN true ELSE review_required END AS review_required,
        newly AS newly_linked, newly_suspected, is_internal_transfer OR newly AS is_internal_transfer
        FROM (SELECT *, is_transfer AND NOT is_internal_transfer AS newly,
              suspected AND NOT suspected_transfer AND NOT is_internal_transfer AS newly_suspected FROM linked)""",
        SQL_PAIRS,
    ),
)
def relink_ledger(spark, sf_dir):
    done = transfers.relink(linked_legs(spark, sf_dir))
    return done.select(
        "txn_id", "flow", "category", "suspected_transfer", "review_required", "newly_linked", "newly_suspected", "is_internal_transfer"
    )


@query(
    "transfer_candidates",
    on_legs(
        f"""SELECT owner_id, abs_amount, piece::BIGINT AS piece, count(*) FILTER (WHERE side = 'debit')::BIGINT AS debits,
        count(*) FILTER (WHERE side = 'credit')::BIGINT AS credits
        FROM (SELECT *, sum(starts) OVER (PARTITION BY owner_id, abs_amount ORDER BY txn_date) AS piece
          FROM (SELECT *, CASE WHEN date_diff('day', lag(txn_date) OVER (PARTITION BY owner_id, abs_amount ORDER BY txn_date), txn_date) > 4 THEN 1 ELSE 0 END AS starts
                FROM legs WHERE explicit OR bare))
        GROUP BY owner_id, abs_amount, piece HAVING debits > 0 AND credits > 0"""
    ),
)
def transfer_candidates(spark, sf_dir):
    """Independent pieces in which at least one debit could meet a credit."""
    flagged = transfers.with_flags(event_legs(spark, sf_dir), own_names()).filter("explicit or bare")
    runs = flagged.groupBy(*transfers.AMOUNT, "side", *transfers.RUN).agg(F.count("*").alias("rows"))
    pieces = transfers._with_pieces(runs, fv.TRANSFER_WINDOW_DAYS)
    rows = F.col("rows")
    return pieces.groupBy(*transfers.AMOUNT, "piece").agg(
        F.sum(F.when(F.col("side") == "debit", rows).otherwise(0)).alias("debits"),
        F.sum(F.when(F.col("side") == "credit", rows).otherwise(0)).alias("credits"),
    )
