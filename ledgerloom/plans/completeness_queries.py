"""Completeness of the bound ledgers: balance chains, missing months, later corrections, transfer closure."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.operators import completeness
from ledgerloom.plans import bindings as b
from ledgerloom.plans.integrity_queries import SQL_PAIRS, linked_legs, on_legs
from ledgerloom.plans.registry import query


# ------------------------------------------------------------------------- balance chains
def captured_rows(spark, sf_dir):
    """Orders as statement rows with the running balance of their account: some rows are lost, some balances not
    captured, some captured wrongly."""
    rows = b.ledger_orders(spark, sf_dir).select("owner_id", "own_account_id", "txn_id", "txn_date", "seq", "amount")
    so_far = Window.partitionBy("own_account_id").orderBy("txn_date", "seq", "txn_id").rowsBetween(Window.unboundedPreceding, 0)
    balance = F.sum("amount").over(so_far) + F.when(F.col("seq") % 41 == 0, 100).otherwise(0)
    return rows.withColumn("balance", F.when(F.col("seq") % 4 != 3, balance)).filter("seq % 23 <> 0")


SQL_CHAIN = """
kept AS (SELECT owner_id, own_account_id, txn_id, txn_date, seq, amount, CASE WHEN seq % 4 <> 3 THEN balance END AS balance
  FROM (SELECT *, CAST(sum(amount) OVER (PARTITION BY own_account_id ORDER BY txn_date, seq, txn_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
          + CASE WHEN seq % 41 = 0 THEN 100 ELSE 0 END AS balance FROM ledger_orders) WHERE seq % 23 <> 0),
placed AS (SELECT *, count(balance) OVER w - CASE WHEN balance IS NULL THEN 0 ELSE 1 END AS link FROM kept
  WINDOW w AS (PARTITION BY owner_id, own_account_id ORDER BY txn_date, seq, txn_id ROWS UNBOUNDED PRECEDING)),
links AS (SELECT owner_id, own_account_id, link, CAST(sum(amount) AS BIGINT) AS moved, max(balance) AS balance FROM placed GROUP BY ALL),
chain AS (SELECT p.*, CASE WHEN p.balance IS NOT NULL AND p.link > 0 THEN before.balance + l.moved END AS expected_balance
  FROM placed p JOIN links l USING (owner_id, own_account_id, link)
  LEFT JOIN links before ON before.owner_id = p.owner_id AND before.own_account_id = p.own_account_id AND before.link = p.link - 1)"""


@query(
    "balance_breaks",
    b.with_ctes(
        b.SQL_ORDERS, SQL_CHAIN,
        select="SELECT owner_id, own_account_id, txn_id, txn_date, balance, expected_balance, balance - expected_balance AS difference FROM chain WHERE balance <> expected_balance",
    ),
)
def balance_breaks(spark, sf_dir):
    chain = completeness.balance_chain(captured_rows(spark, sf_dir)).filter("broken")
    return chain.select("owner_id", "own_account_id", "txn_id", "txn_date", "balance", "expected_balance", "difference")


@query(
    "balance_card",
    b.with_ctes(
        b.SQL_ORDERS, SQL_CHAIN,
        select=f"""SELECT owner_id, own_account_id, {b.sql_fy('txn_date')} AS fy_key, count(*) AS rows, count(balance) AS captured, count(expected_balance) AS checked,
        count(*) FILTER (WHERE balance <> expected_balance) AS breaks, min(txn_date) FILTER (WHERE balance <> expected_balance) AS first_break,
        CAST(coalesce(sum(balance - expected_balance) FILTER (WHERE balance <> expected_balance), 0) AS BIGINT) AS unexplained FROM chain GROUP BY 1, 2, 3""",
    ),
)
def balance_card(spark, sf_dir):
    return completeness.balance_card(completeness.balance_chain(captured_rows(spark, sf_dir)))


# ------------------------------------------------------------------------- missing months
SQL_MONTHS = """
months AS (SELECT DISTINCT owner_id, own_account_id, CAST(date_trunc('month', txn_date) AS DATE) AS month FROM ledger_orders),
spine AS (SELECT owner_id, own_account_id, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM months GROUP BY 1, 2),
marked AS (SELECT s.*, m.month IS NOT NULL AS seen FROM spine s LEFT JOIN months m USING (owner_id, own_account_id, month)),
runs AS (SELECT *, row_number() OVER (PARTITION BY owner_id, own_account_id ORDER BY month)
  - row_number() OVER (PARTITION BY owner_id, own_account_id, seen ORDER BY month) AS run FROM marked)"""


def on_months(select: str) -> str:
    return b.with_ctes(b.SQL_ORDERS, SQL_MONTHS, select=select)


@query(
    "month_gaps",
    on_months(
        """SELECT owner_id, own_account_id, min(month) AS first_missing, max(month) AS last_missing, CAST(count(*) AS INTEGER) AS months
        FROM runs WHERE NOT seen GROUP BY owner_id, own_account_id, run"""
    ),
)
def month_gaps(spark, sf_dir):
    return completeness.month_gaps(b.ledger_orders(spark, sf_dir))


@query(
    "month_islands",
    on_months("SELECT owner_id, own_account_id, min(month) AS first_month, max(month) AS last_month, count(*) AS months FROM runs WHERE seen GROUP BY owner_id, own_account_id, run"),
)
def month_islands(spark, sf_dir):
    return completeness.month_islands(b.ledger_orders(spark, sf_dir))


@query(
    "month_completeness",
    on_months(
        f"""SELECT owner_id, own_account_id, {b.sql_fy('month')} AS fy_key, count(*) FILTER (WHERE seen) AS seen, count(*) FILTER (WHERE NOT seen) AS missing,
        count(*) FILTER (WHERE seen) / count(*) AS completeness FROM marked GROUP BY 1, 2, 3"""
    ),
)
def month_completeness(spark, sf_dir):
    return completeness.month_completeness(b.ledger_orders(spark, sf_dir))


# ---------------------------------------------------------------------- later corrections
CATEGORIES = ["Groceries", "Dining", "Travel"]


def _judged(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    key = F.col("event_id")
    return e.select(
        F.floor(F.col("user_id") / 10).cast("bigint").alias("owner_id"), F.concat(F.lit("u"), F.col("user_id"), F.lit("_"), key % 3).alias("txn_id"),
        F.concat(F.lit("p"), key).alias("id"), F.get(F.array(*[F.lit(c) for c in CATEGORIES]), (F.floor(key / 3) % 3).cast("int")).alias("category"),
        F.date_trunc("hour", "ts").alias("at"), F.col("event_type").isin("view", "click").alias("decision"),
    )


def decisions(spark, sf_dir):
    return _judged(spark, sf_dir).filter("decision").select("owner_id", "txn_id", F.col("id").alias("prediction_id"), "category", F.col("at").alias("decided_at"))


def corrections(spark, sf_dir):
    return _judged(spark, sf_dir).filter("not decision").select("owner_id", "txn_id", F.col("id").alias("feedback_id"), "category", F.col("at").alias("created_at"))


SQL_OUTCOMES = f"""
judged AS (SELECT CAST(floor(user_id / 10) AS BIGINT) AS owner_id, 'u' || user_id || '_' || (event_id % 3) AS txn_id, 'p' || event_id AS id,
  {CATEGORIES!r}[(event_id // 3) % 3 + 1] AS category, date_trunc('hour', ts) AS at_hour, event_type IN ('view', 'click') AS decision FROM events),
outcomes AS (SELECT d.owner_id, d.txn_id, d.id AS prediction_id, d.category, c.n.id AS feedback_id,
    CASE WHEN c.n IS NULL THEN 'untouched' WHEN c.n.category = d.category THEN 'confirmed' ELSE 'corrected' END AS outcome
  FROM (SELECT * FROM judged WHERE decision) d LEFT JOIN (
    SELECT p.id, min({{'at': f.at_hour, 'id': f.id, 'category': f.category}}) AS n FROM judged p JOIN judged f
      ON f.owner_id = p.owner_id AND f.txn_id = p.txn_id AND f.at_hour > p.at_hour WHERE p.decision AND NOT f.decision GROUP BY p.id) c ON c.id = d.id)"""


@query("accept_outcomes", b.with_ctes(SQL_OUTCOMES, select="SELECT * FROM outcomes"))
def accept_outcomes(spark, sf_dir):
    found = completeness.accepted_outcomes(decisions(spark, sf_dir), corrections(spark, sf_dir))
    return found.select("owner_id", "txn_id", "prediction_id", "category", "feedback_id", "outcome")


@query(
    "accept_precision",
    b.with_ctes(
        SQL_OUTCOMES,
        select="""SELECT owner_id, category, count(*) AS accepted, count(*) FILTER (WHERE outcome = 'confirmed') AS confirmed,
        count(*) FILTER (WHERE outcome = 'corrected') AS corrected, count(*) FILTER (WHERE outcome <> 'corrected') / count(*) AS precision FROM outcomes GROUP BY 1, 2""",
    ),
)
def accept_precision(spark, sf_dir):
    return completeness.accept_precision(completeness.accepted_outcomes(decisions(spark, sf_dir), corrections(spark, sf_dir)))


# ----------------------------------------------------------------------- transfer closure
def _sql_open(name: str, test: str) -> str:
    return f"{', '.join(f'count(*) FILTER (WHERE {test} AND {when}) AS {name}_{age}' for age, when in (('waiting', f'age <= {fv.TRANSFER_WINDOW_DAYS}'), ('open', f'age > {fv.TRANSFER_WINDOW_DAYS} AND age <= 30'), ('overdue', 'age > 30')))}"


@query(
    "transfer_closure",
    on_legs(
        f"""SELECT owner_id, count(other_txn_id) AS linked_legs,
        CAST(coalesce(sum(amount) FILTER (WHERE other_txn_id IS NOT NULL AND amount < 0), 0) AS BIGINT) AS linked_debits,
        CAST(coalesce(sum(amount) FILTER (WHERE other_txn_id IS NOT NULL AND amount > 0), 0) AS BIGINT) AS linked_credits,
        {_sql_open('single', 'is_transfer AND other_txn_id IS NULL')}, {_sql_open('suspected', 'suspected')},
        CAST(coalesce(sum(amount) FILTER (WHERE suspected), 0) AS BIGINT) AS suspected_amount,
        coalesce(sum(amount) FILTER (WHERE other_txn_id IS NOT NULL), 0) = 0 AS balanced,
        count(*) FILTER (WHERE suspected AND age > 30) = 0 AS closed
        FROM (SELECT *, date_diff('day', txn_date, max(txn_date) OVER (PARTITION BY owner_id)) AS age FROM linked) GROUP BY owner_id""",
        SQL_PAIRS,
    ),
)
def transfer_closure(spark, sf_dir):
    return completeness.transfer_closure(linked_legs(spark, sf_dir))


SQL_TAMPERED = """
stored AS (SELECT owner_id, txn_id, txn_date, CASE WHEN try_cast(substr(txn_id, 2) AS BIGINT) % 31 = 0 THEN amount * 2 ELSE amount END AS amount,
  CASE WHEN try_cast(substr(txn_id, 2) AS BIGINT) % 43 <> 0 THEN other_txn_id END AS other_txn_id FROM linked),
ends AS (SELECT *, CASE WHEN amount < 0 THEN txn_id ELSE other_txn_id END AS debit_txn_id, CASE WHEN amount < 0 THEN other_txn_id ELSE txn_id END AS credit_txn_id
  FROM stored WHERE other_txn_id IS NOT NULL),
tampered AS (SELECT owner_id, debit_txn_id, credit_txn_id, count(*) AS ends, sum(amount) AS net FROM ends GROUP BY ALL)"""


@query(
    "link_violations",
    on_legs(
        """SELECT owner_id, debit_txn_id, credit_txn_id, 'one leg only' AS violation FROM tampered WHERE ends < 2
        UNION ALL SELECT owner_id, debit_txn_id, credit_txn_id, 'amounts differ' FROM tampered WHERE ends = 2 AND net <> 0""",
        SQL_PAIRS, SQL_TAMPERED,
    ),
)
def link_violations(spark, sf_dir):
    """Links stored some time ago, of which some legs were since unlinked or changed in amount."""
    number = F.substring("txn_id", 2, 20).cast("bigint")
    stored = linked_legs(spark, sf_dir).withColumns(
        {"amount": F.when(number % 31 == 0, F.col("amount") * 2).otherwise(F.col("amount")), "other_txn_id": F.when(number % 43 != 0, F.col("other_txn_id"))}
    )
    return completeness.link_violations(stored)
