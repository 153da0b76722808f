"""Rollups, filters and list queries over the bound ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import money, period, text
from ledgerloom.operators import rollups as r
from ledgerloom.plans import bindings as b
from ledgerloom.plans.registry import query

P = "owner_id, fy_key"
SQL_SPENDING = "flow = 'expense' AND NOT is_internal_transfer"
SQL_INCOME = "flow = 'income' AND NOT is_internal_transfer AND NOT suspected_transfer"
SQL_MERCHANT = "coalesce(merchant, subcategory, category)"


def on_lines(select: str, *ctes: str) -> str:
    return b.with_ctes(b.SQL_LINES, *ctes, select=select)


FLOW_SUMS = f"""
sums AS (
  SELECT {P},
    coalesce(sum(amount) FILTER (WHERE {SQL_INCOME}), 0)::BIGINT AS income_minor,
    coalesce(sum(amount) FILTER (WHERE {SQL_SPENDING}), 0)::BIGINT AS expense_minor,
    coalesce(sum(amount) FILTER (WHERE flow = 'investment' AND NOT is_internal_transfer), 0)::BIGINT AS investment_minor,
    count(*)::BIGINT AS txn_count
  FROM ledger_lines GROUP BY ALL)"""


@query("flow_sum", on_lines("SELECT * FROM sums", FLOW_SUMS))
def flow_sum(spark, sf_dir):
    return r.flow_sums(b.ledger_lines(spark, sf_dir))


def sql_rate(income: str, expense: str) -> str:
    return f"CASE WHEN {income} > 0 THEN {b.sql_round(f'({income} - {expense})::DOUBLE / {income}::DOUBLE * 100')} ELSE 0 END"


@query(
    "overview",
    on_lines(
        f"""SELECT c.owner_id, c.fy_key, c.income, c.expenses, c.invested, c.income - c.expenses AS net,
        ({sql_rate('c.income', 'c.expenses')})::BIGINT AS savings_rate,
        coalesce({sql_rate('p.income', 'p.expenses')}, 0)::BIGINT AS prev_savings_rate, c.txn_count
        FROM major c LEFT JOIN major p ON p.owner_id = c.owner_id
         AND substr(p.fy_key, 1, 4)::INT + 1 = substr(c.fy_key, 1, 4)::INT""",
        FLOW_SUMS,
        f"""major AS (SELECT {P}, {b.sql_major('income_minor')} AS income, {b.sql_major('abs(expense_minor)')} AS expenses,
        {b.sql_major('abs(investment_minor)')} AS invested, txn_count FROM sums)""",
    ),
)
def overview(spark, sf_dir):
    return r.overview(b.ledger_lines(spark, sf_dir))


def sql_top(name: str, limit: int, default: str) -> str:
    return on_lines(
        f"SELECT {P}, position, coalesce(name, '{default}') AS name, {b.sql_major('minor')} AS amount FROM ranked WHERE position <= {limit}",
        f"""ranked AS (SELECT {P}, name, minor, (row_number() OVER (PARTITION BY {P} ORDER BY minor DESC, name NULLS FIRST))::INT AS position
        FROM (SELECT {P}, {name} AS name, sum(abs(amount))::BIGINT AS minor FROM ledger_lines WHERE {SQL_SPENDING} GROUP BY ALL))""",
    )


@query("top_categories", sql_top("category", 6, "Uncategorised"))
def top_categories(spark, sf_dir):
    return r.top_categories(b.ledger_lines(spark, sf_dir))


@query("top_merchants", sql_top(SQL_MERCHANT, 5, "Unknown"))
def top_merchants(spark, sf_dir):
    return r.top_merchants(b.ledger_lines(spark, sf_dir))


SQL_DISPLAY = f"""SELECT owner_id, fy_key, txn_id, txn_date, coalesce({SQL_MERCHANT}, 'Unknown') AS merchant,
  coalesce(category, 'Uncategorised') AS category, subcategory, {b.sql_major('amount')} AS amount,
  coalesce(flow, 'expense') AS flow, confidence, layer::INT AS layer, reason, signal, source, accepted_prediction_id,
  coalesce(review_required, false) AS review_required, tax_section, from_addr, subject
  FROM chosen LEFT JOIN messages USING (message_id)"""


def sql_recent(where: str, limit: int) -> str:
    return on_lines(
        SQL_DISPLAY,
        b.SQL_MESSAGES,
        f"""chosen AS (SELECT * FROM ledger_lines WHERE {where}
        QUALIFY row_number() OVER (PARTITION BY {P} ORDER BY txn_date DESC, txn_id) <= {limit})""",
    )


def _recent(condition, limit):
    def run(spark, sf_dir):
        return r.recent(b.ledger_lines(spark, sf_dir), b.messages(spark, sf_dir), condition and condition(), limit)

    return run


query("recent_rows", sql_recent("true", 8))(_recent(None, 8))
query("income_rows", sql_recent(SQL_INCOME, 50))(_recent(r.income, 50))
query("expense_rows", sql_recent(SQL_SPENDING, 100))(_recent(r.spending, 100))
query("tax_evidence_rows", sql_recent("tax_section IS NOT NULL", 50))(_recent(lambda: F.col("tax_section").isNotNull(), 50))


@query("ledger_projection", on_lines(SQL_DISPLAY, b.SQL_MESSAGES, "chosen AS (SELECT * FROM ledger_lines)"))
def ledger_projection(spark, sf_dir):
    return r.display_rows(b.ledger_lines(spark, sf_dir), b.messages(spark, sf_dir))


@query(
    "txn_source",
    on_lines(
        "SELECT txn_id, message_id, from_addr, subject FROM ledger_lines LEFT JOIN messages USING (message_id)",
        b.SQL_MESSAGES,
    ),
)
def txn_source(spark, sf_dir):
    source = b.messages(spark, sf_dir).select("message_id", "from_addr", "subject")
    return b.ledger_lines(spark, sf_dir).select("txn_id", "message_id").join(source, "message_id", "left")


MONTH_NAMES = "['Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec','Jan','Feb','Mar']"


@query(
    "income_months",
    on_lines(
        f"""SELECT k.owner_id, k.fy_key, m.month_no::INT AS month_no, {MONTH_NAMES}[m.month_no] AS month,
        coalesce(s.salary, 0)::BIGINT AS salary, coalesce(s.other, 0)::BIGINT AS other
        FROM (SELECT DISTINCT {P} FROM inc) k CROSS JOIN (SELECT unnest(range(1, 13)) AS month_no) m
        LEFT JOIN (SELECT {P}, month_no, sum(CASE WHEN salary THEN major ELSE 0 END) AS salary,
                   sum(CASE WHEN salary THEN 0 ELSE major END) AS other FROM inc GROUP BY ALL) s
          ON s.owner_id = k.owner_id AND s.fy_key = k.fy_key AND s.month_no = m.month_no""",
        f"""inc AS (SELECT {P}, (month(txn_date) + 8) % 12 + 1 AS month_no, lower(category) = 'salary' AS salary,
        {b.sql_major('amount')} AS major FROM ledger_lines WHERE {SQL_INCOME})""",
    ),
)
def income_months(spark, sf_dir):
    return r.income_months(b.ledger_lines(spark, sf_dir))


@query(
    "income_total",
    on_lines(
        f"""SELECT {P},
        coalesce(sum({b.sql_major('amount')}) FILTER (WHERE {SQL_INCOME} AND lower(category) = 'salary'), 0)::BIGINT AS salary_total,
        coalesce(sum({b.sql_major('amount')}) FILTER (WHERE {SQL_INCOME} AND lower(category) <> 'salary'), 0)::BIGINT AS other_total,
        coalesce(sum({b.sql_major('amount')}) FILTER (WHERE {SQL_INCOME}), 0)::BIGINT AS total,
        arg_min(subcategory, (txn_date, txn_id)) FILTER (WHERE lower(category) = 'salary' AND subcategory IS NOT NULL) AS employer,
        count(*) FILTER (WHERE {SQL_INCOME})::BIGINT AS income_rows
        FROM ledger_lines GROUP BY ALL"""
    ),
)
def income_total(spark, sf_dir):
    return r.income_totals(b.ledger_lines(spark, sf_dir))


SQL_CHILDREN = f"""
children AS (SELECT {P}, coalesce(category, 'Uncategorised') AS category, subcategory,
  {b.sql_major('sum(abs(amount))')} AS amount, max(is_recurring::INT)::INT AS recurring, max(project_id) AS project
  FROM ledger_lines WHERE {SQL_SPENDING} GROUP BY {P}, category, subcategory)"""
SQL_TREE = f"""
tree AS (SELECT {P}, category, sum(amount)::BIGINT AS amount, max(recurring) = 1 AS recurring,
  max(project) AS project, count(subcategory)::BIGINT AS children FROM children GROUP BY {P}, category)"""


@query("expense_children", on_lines("SELECT * FROM children", SQL_CHILDREN))
def expense_children(spark, sf_dir):
    return r.expense_children(b.ledger_lines(spark, sf_dir))


@query("expense_tree", on_lines("SELECT * FROM tree", SQL_CHILDREN, SQL_TREE))
def expense_tree(spark, sf_dir):
    return r.expense_tree(b.ledger_lines(spark, sf_dir))


@query(
    "category_share",
    on_lines(
        f"""SELECT {P}, category, amount, {b.sql_round('amount::DOUBLE / sum(amount) OVER w::DOUBLE * 100')} AS pct_of_total,
        {b.sql_round('amount::DOUBLE / max(amount) OVER w::DOUBLE * 100')} AS pct_of_largest
        FROM tree WINDOW w AS (PARTITION BY {P})""",
        SQL_CHILDREN,
        SQL_TREE,
    ),
)
def category_share(spark, sf_dir):
    return r.category_share(b.ledger_lines(spark, sf_dir))


@query(
    "tax_sections",
    on_lines(
        f"""SELECT {P}, tax_section, sum(abs(amount))::BIGINT AS minor, count(*)::BIGINT AS evidence
        FROM ledger_lines WHERE tax_section IS NOT NULL GROUP BY ALL"""
    ),
)
def tax_sections(spark, sf_dir):
    return r.tax_sections(b.ledger_lines(spark, sf_dir))


@query(
    "rent_total",
    on_lines(
        f"""SELECT {P}, sum(abs(amount))::BIGINT AS rent_minor, count(*)::BIGINT AS rent_rows FROM ledger_lines
        WHERE flow = 'expense' AND lower(subcategory) = 'rent' GROUP BY ALL"""
    ),
)
def rent_total(spark, sf_dir):
    return r.rent_totals(b.ledger_lines(spark, sf_dir))


@query(
    "investments",
    on_lines(
        f"""SELECT {P}, coalesce(subcategory, institution_id, 'Investments') AS platform,
        {b.sql_major('sum(abs(amount))')} AS invested FROM ledger_lines WHERE flow = 'investment'
        GROUP BY {P}, coalesce(subcategory, institution_id, 'Investments')"""
    ),
)
def investments(spark, sf_dir):
    return r.investments(b.ledger_lines(spark, sf_dir))


@query(
    "loans",
    on_lines(
        f"""SELECT {P}, coalesce(subcategory, category) AS name, {b.sql_major('max(abs(amount))')} AS emi,
        max(tax_section) AS tax_section FROM ledger_lines WHERE lower(category) = 'loan'
        GROUP BY {P}, coalesce(subcategory, category)"""
    ),
)
def loans(spark, sf_dir):
    return r.loans(b.ledger_lines(spark, sf_dir))


@query(
    "insurance",
    on_lines(
        f"""SELECT {P}, coalesce(merchant, subcategory, 'Insurance') AS name, {b.sql_major('sum(abs(amount))')} AS premium,
        coalesce(max(tax_section), '80D') AS section FROM ledger_lines WHERE lower(category) = 'insurance'
        GROUP BY {P}, coalesce(merchant, subcategory, 'Insurance')"""
    ),
)
def insurance(spark, sf_dir):
    return r.insurance(b.ledger_lines(spark, sf_dir))


@query("available_periods", on_lines(f"SELECT DISTINCT {P} FROM ledger_lines"))
def available_periods(spark, sf_dir):
    return r.available_periods(b.ledger_lines(spark, sf_dir))


@query("latest_period", on_lines("SELECT owner_id, max(fy_key) AS fy_key FROM ledger_lines GROUP BY ALL"))
def latest_period(spark, sf_dir):
    return r.latest_period(b.ledger_lines(spark, sf_dir))


@query(
    "cashflow",
    on_lines(
        f"""SELECT {P}, income, outflow, income - outflow AS net FROM (SELECT {P},
        coalesce(sum(amount) FILTER (WHERE flow = 'income'), 0)::BIGINT AS income,
        (abs(coalesce(sum(amount) FILTER (WHERE flow = 'expense'), 0))
         + abs(coalesce(sum(amount) FILTER (WHERE flow = 'investment'), 0)))::BIGINT AS outflow
        FROM ledger_lines GROUP BY ALL)"""
    ),
)
def cashflow(spark, sf_dir):
    return r.cashflow(b.ledger_lines(spark, sf_dir))


@query(
    "category_spend",
    on_lines(
        f"SELECT {P}, category, sum(abs(amount))::BIGINT AS total, count(*)::BIGINT AS rows FROM ledger_lines GROUP BY ALL"
    ),
)
def category_spend(spark, sf_dir):
    return r.category_spend(b.ledger_lines(spark, sf_dir))


@query("by_period_counts", b.with_ctes(b.SQL_ORDERS, select=f"SELECT {P}, count(*)::BIGINT AS rows FROM ledger_orders GROUP BY ALL"))
def by_period_counts(spark, sf_dir):
    return b.ledger_orders(spark, sf_dir).groupBy("owner_id", "fy_key").agg(F.count("*").alias("rows"))


@query(
    "category_frequency",
    on_lines(
        """SELECT * FROM (SELECT owner_id, lower(category) AS category, count(*)::BIGINT AS rows,
        (row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, lower(category)))::INT AS position
        FROM ledger_lines WHERE NOT review_required AND lower(category) <> 'uncategorised' AND category <> '' GROUP BY 1, 2)
        WHERE position <= 8"""
    ),
)
def category_frequency(spark, sf_dir):
    return r.category_frequency(b.ledger_lines(spark, sf_dir))


# ---------------------------------------------------------------------------- filters
SQL_ROW = "owner_id, txn_id, txn_date, merchant, category, amount"
ROW = ["owner_id", "txn_id", "txn_date", "merchant", "category", "amount"]


def latest_per_owner(frame, limit):
    return r.latest(frame, ["owner_id"], limit).select(*ROW)


def sql_latest_per_owner(where: str, limit: int, columns: str = SQL_ROW) -> str:
    return on_lines(
        f"""SELECT {columns} FROM ledger_lines WHERE {where}
        QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY txn_date DESC, txn_id) <= {limit}"""
    )


@query("ledger_list", sql_latest_per_owner("fy_key = '1999-00' AND flow = 'expense' AND (lower(coalesce(merchant, '')) LIKE '%d#1_%' OR lower(coalesce(raw_description, '')) LIKE '%d#1_%' OR lower(coalesce(category, '')) LIKE '%d#1_%')", 300))
def ledger_list(spark, sf_dir):
    rows = r.list_rows(b.ledger_lines(spark, sf_dir), like="d#1_", fy_key="1999-00", flow="expense")
    return latest_per_owner(rows, 300)


@query("list_like_unescaped", on_lines(f"SELECT {SQL_ROW} FROM ledger_lines WHERE lower(coalesce(merchant, '')) LIKE '%b_and#2%' OR lower(coalesce(raw_description, '')) LIKE '%b_and#2%' OR lower(coalesce(category, '')) LIKE '%b_and#2%'"))
def list_like_unescaped(spark, sf_dir):
    return r.list_rows(b.ledger_lines(spark, sf_dir), like="B_and#2").select(*ROW)


def sql_contains(needle: str) -> str:
    columns = ("merchant", "raw_description", "category", "subcategory")
    return " OR ".join(f"contains(lower(coalesce({c}, '')), '{needle}')" for c in columns)


@query("search_text", sql_latest_per_owner(sql_contains("old rod g"), 12))
def search_text(spark, sf_dir):
    return latest_per_owner(r.search(b.ledger_lines(spark, sf_dir), "Old Rod G"), 12)


@query("search_wildcards", on_lines(f"SELECT {SQL_ROW} FROM ledger_lines WHERE {sql_contains('g_zmo')} OR {sql_contains('gizmo e')}"))
def search_wildcards(spark, sf_dir):
    ledger = b.ledger_lines(spark, sf_dir)
    return r.search(ledger, "g_zmo").union(r.search(ledger, "gizmo e")).select(*ROW).distinct()


@query("search_amount", on_lines(f"SELECT {SQL_ROW} FROM ledger_lines WHERE abs(amount) = 6842346 OR ({sql_contains('₹ 68,423.46')})"))
def search_amount(spark, sf_dir):
    return r.search(b.ledger_lines(spark, sf_dir), "₹ 68,423.46").select(*ROW)


@query("merchant_ilike", sql_latest_per_owner("merchant ILIKE '%brand#7%' OR raw_description ILIKE '%brand#7%'", 25))
def merchant_ilike(spark, sf_dir):
    return latest_per_owner(r.merchant_search(b.ledger_lines(spark, sf_dir), "BRAND#_7"), 25)


@query("display_name", on_lines(f"SELECT txn_id, coalesce({SQL_MERCHANT}, 'Unknown') AS name FROM ledger_lines"))
def display_name(spark, sf_dir):
    return b.ledger_lines(spark, sf_dir).select("txn_id", F.coalesce(r.merchant_name(), F.lit("Unknown")).alias("name"))


@query(
    "optional_conjuncts",
    on_lines(f"SELECT {SQL_ROW} FROM ledger_lines WHERE flow = 'expense' AND category = 'Groceries' AND confidence = 'med'"),
)
def optional_conjuncts(spark, sf_dir):
    rows = r.list_rows(b.ledger_lines(spark, sf_dir), flow="expense", fy_key=None, category="Groceries", confidence="med")
    return rows.select(*ROW)


@query(
    "in_period",
    b.with_ctes(b.SQL_ORDERS, select="SELECT owner_id, txn_id FROM ledger_orders WHERE txn_date BETWEEN DATE '1999-04-01' AND DATE '2000-03-31'"),
)
def in_period(spark, sf_dir):
    ledger = b.ledger_orders(spark, sf_dir)
    return ledger.filter(period.in_fy(F.col("txn_date"), F.lit("1999-00"))).select("owner_id", "txn_id")


@query(
    "income_quarantine",
    on_lines(
        f"""SELECT {P}, count(*) FILTER (WHERE {SQL_INCOME})::BIGINT AS counted_income,
        count(*) FILTER (WHERE flow = 'income' AND suspected_transfer)::BIGINT AS quarantined,
        count(*) FILTER (WHERE {SQL_SPENDING})::BIGINT AS counted_spending,
        count(*) FILTER (WHERE flow = 'investment')::BIGINT AS listed_investments FROM ledger_lines GROUP BY ALL"""
    ),
)
def income_quarantine(spark, sf_dir):
    return b.ledger_lines(spark, sf_dir).groupBy("owner_id", "fy_key").agg(
        F.count_if(r.income()).alias("counted_income"),
        F.count_if((F.col("flow") == "income") & F.col("suspected_transfer")).alias("quarantined"),
        F.count_if(r.spending()).alias("counted_spending"),
        F.count_if(F.col("flow") == "investment").alias("listed_investments"),
    )


PROVENANCE = "owner_id, txn_id, txn_date, merchant, category, subcategory, source, accepted_prediction_id, layer::INT AS layer, reason, raw_description"


@query("provenance_lookup", sql_latest_per_owner("merchant ILIKE '%brand#13%'", 10, PROVENANCE))
def provenance_lookup(spark, sf_dir):
    return r.latest(r.provenance(b.ledger_lines(spark, sf_dir), merchant="Brand#13%"), ["owner_id"], 10)


SQL_INSTITUTIONS = """
institutions AS (
  SELECT 'sup-' || s_suppkey AS institution_id, s_name AS display_name,
    CASE WHEN s_suppkey % 3 = 0 THEN 'bank' ELSE 'merchant' END AS category,
    ['nation ' || s_nationkey, lower(s_name)] AS aliases FROM supplier)"""


def institutions(spark, sf_dir):
    s = b.table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("sup-"), F.col("s_suppkey")).alias("institution_id"),
        F.col("s_name").alias("display_name"),
        F.when(F.col("s_suppkey") % 3 == 0, "bank").otherwise("merchant").alias("category"),
        F.array(F.concat(F.lit("nation "), F.col("s_nationkey")), F.lower("s_name")).alias("aliases"),
    )


def institution_search(rows, needle: str, category: str | None = None, limit: int = 20):
    """Name, id or any alias, wildcards live; at most 50 rows."""
    wanted = f"%{needle.strip().lower()}%"
    if category is not None:
        rows = rows.filter(F.col("category") == category)
    listed = F.lower(F.to_json("aliases"))
    hit = F.lower("display_name").like(wanted) | F.lower("institution_id").like(wanted) | listed.like(wanted)
    return rows.filter(hit).orderBy("institution_id").limit(min(limit, 50))


@query(
    "institution_search",
    b.with_ctes(
        SQL_INSTITUTIONS,
        select="""SELECT institution_id, display_name, category FROM institutions WHERE category = 'merchant'
        AND (lower(display_name) LIKE '%nation 1_%' OR lower(institution_id) LIKE '%nation 1_%' OR lower(to_json(aliases)::VARCHAR) LIKE '%nation 1_%')
        ORDER BY institution_id LIMIT 50""",
    ),
)
def institution_search_query(spark, sf_dir):
    found = institution_search(institutions(spark, sf_dir), "nation 1_", category="merchant", limit=80)
    return found.select("institution_id", "display_name", "category")


@query(
    "id_to_name",
    b.with_ctes(
        SQL_INSTITUTIONS,
        select="""SELECT institution_id, display_name FROM institutions
        WHERE institution_id IN (SELECT 'sup-' || l_suppkey FROM lineitem WHERE l_quantity >= 50)""",
    ),
)
def id_to_name(spark, sf_dir):
    wanted = b.table(spark, sf_dir, "lineitem").filter("l_quantity >= 50").select(
        F.concat(F.lit("sup-"), F.col("l_suppkey")).alias("institution_id")
    )
    return institutions(spark, sf_dir).join(wanted, "institution_id", "left_semi").select("institution_id", "display_name")


# ----------------------------------------------------------------- sources and review
SQL_ATTACHMENTS = """
attachments AS (
  SELECT 'att_' || doc_id AS attachment_id, 'run_' || (doc_id % 7) AS run_id, 'm' || (doc_id % 400) AS message_id,
    CASE WHEN doc_id % 10 < 6 THEN 'extracted' WHEN doc_id % 10 < 8 THEN 'pending' WHEN doc_id % 10 = 8 THEN 'review' ELSE 'failed' END AS status,
    text, n_chars FROM documents)"""


def attachments(spark, sf_dir):
    last = F.col("doc_id") % 10
    return b.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("att_"), F.col("doc_id")).alias("attachment_id"),
        F.concat(F.lit("run_"), F.col("doc_id") % 7).alias("run_id"),
        F.concat(F.lit("m"), F.col("doc_id") % 400).alias("message_id"),
        F.when(last < 6, "extracted").when(last < 8, "pending").when(last == 8, "review").otherwise("failed").alias("status"),
        "text", "n_chars",
    )


def sql_bytes(value: str) -> str:
    arms = []
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")):
        scaled = f"({value} / {1024.0 ** power})"
        arms.append(
            f"WHEN {value} >= {1024 ** power} THEN CASE WHEN {scaled} >= 10 THEN printf('%.0f', {scaled}::DOUBLE)"
            f" ELSE printf('%.1f', {scaled}::DOUBLE) END || ' {unit}'"
        )
    return f"CASE {' '.join(arms)} ELSE printf('%.0f', {value}::DOUBLE) || ' B' END"


@query(
    "source_runs",
    b.with_ctes(
        b.SQL_MESSAGES,
        SQL_ATTACHMENTS,
        select=f"""SELECT run_id, messages, {sql_bytes('bytes')} AS size, coalesce(attachments, 0)::BIGINT AS attachments,
        CASE WHEN attachments > 0 THEN {b.sql_round('extracted::DOUBLE / attachments::DOUBLE * 100')} END AS coverage
        FROM (SELECT run_id, count(*)::BIGINT AS messages, sum(bytes)::BIGINT AS bytes FROM messages GROUP BY 1)
        LEFT JOIN (SELECT run_id, count(*) AS attachments, count(*) FILTER (WHERE status = 'extracted') AS extracted
                   FROM attachments GROUP BY 1) USING (run_id)""",
    ),
)
def source_runs(spark, sf_dir):
    return r.source_runs(b.messages(spark, sf_dir), attachments(spark, sf_dir))


SQL_OPEN_ITEMS = f"""
review_items AS (
  SELECT 'rev_' || doc_id AS item_id, doc_id % 50 AS owner_id,
    CASE doc_id % 4 WHEN 0 THEN 'locked_pdf' WHEN 1 THEN 'account_unresolved' WHEN 2 THEN 'uncategorised' ELSE 'low_confidence' END AS kind,
    'doc_' || doc_id AS ref_id, CASE WHEN doc_id % 5 = 0 THEN 'resolved' ELSE 'open' END AS status FROM documents)"""


def review_items(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in ("locked_pdf", "account_unresolved", "uncategorised", "low_confidence")])
    return b.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("rev_"), F.col("doc_id")).alias("item_id"),
        (F.col("doc_id") % 50).alias("owner_id"),
        F.get(kinds, (F.col("doc_id") % 4).cast("int")).alias("kind"),
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("ref_id"),
        F.when(F.col("doc_id") % 5 == 0, "resolved").otherwise("open").alias("status"),
    )


@query(
    "review_summary",
    on_lines(
        """SELECT owner_id, coalesce(locked, 0)::BIGINT AS locked, coalesce(uncategorised, 0)::BIGINT AS uncategorised,
        coalesce(low_confidence, 0)::BIGINT AS low_confidence,
        (coalesce(locked, 0) + coalesce(uncategorised, 0) + coalesce(low_confidence, 0))::BIGINT AS total
        FROM (SELECT owner_id, count(*) FILTER (WHERE lower(category) = 'uncategorised') AS uncategorised,
              count(*) FILTER (WHERE lower(category) <> 'uncategorised') AS low_confidence
              FROM ledger_lines WHERE review_required GROUP BY 1)
        FULL JOIN (SELECT owner_id, count(*) AS locked FROM review_items WHERE status = 'open' AND kind = 'locked_pdf' GROUP BY 1) USING (owner_id)""",
        SQL_OPEN_ITEMS,
    ),
)
def review_summary(spark, sf_dir):
    return r.review_summary(b.ledger_lines(spark, sf_dir), review_items(spark, sf_dir))


@query(
    "review_by_kind",
    b.with_ctes(SQL_OPEN_ITEMS, select="SELECT owner_id, kind, count(*)::BIGINT AS items FROM review_items WHERE status = 'open' GROUP BY ALL"),
)
def review_by_kind(spark, sf_dir):
    items = review_items(spark, sf_dir).filter("status = 'open'")
    return items.groupBy("owner_id", "kind").agg(F.count("*").alias("items"))


@query(
    "evidence_total",
    on_lines(
        f"""SELECT {P}, upper(tax_section) AS section, sum(abs(amount))::BIGINT AS total, count(*)::BIGINT AS items
        FROM ledger_lines WHERE tax_section IS NOT NULL GROUP BY ALL"""
    ),
)
def evidence_total(spark, sf_dir):
    evidence = b.ledger_lines(spark, sf_dir).filter("tax_section is not null")
    return evidence.groupBy("owner_id", "fy_key", F.upper("tax_section").alias("section")).agg(
        F.sum(F.abs("amount")).alias("total"), F.count("*").alias("items")
    )


SQL_FIELDS = f"""
fields AS (
  SELECT * FROM (
    SELECT CAST(floor(c_custkey / {b.ACCOUNTS_PER_OWNER}) AS BIGINT) AS owner_id, 'accounts' AS section, 'bank' AS entity,
      (c_custkey % {b.ACCOUNTS_PER_OWNER})::INT AS slot, f AS field,
      CASE f WHEN 'name' THEN CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE ' ' END
             WHEN 'segment' THEN CASE WHEN c_custkey % 6 = 0 THEN c_mktsegment ELSE '' END
             ELSE CASE WHEN c_acctbal > 9000 THEN 'x' ELSE '' END END AS value,
      false AS read_only, true AS editable
    FROM customer, unnest(['name', 'segment', 'balance']) AS t(f)
    UNION ALL
    SELECT CAST(floor(c_custkey / {b.ACCOUNTS_PER_OWNER}) AS BIGINT), 'personal', NULL, 0, 'field' || (c_custkey % 5),
      CASE WHEN c_nationkey % 2 = 0 THEN 'set' ELSE '' END, c_custkey % 7 = 0, c_custkey % 2 = 0 OR true FROM customer))"""


def profile_fields(spark, sf_dir):
    c = b.table(spark, sf_dir, "customer")
    owner = F.floor(F.col("c_custkey") / b.ACCOUNTS_PER_OWNER).cast("bigint").alias("owner_id")
    key = F.col("c_custkey")
    slots = c.select(
        owner, F.lit("accounts").alias("section"), F.lit("bank").alias("entity"),
        (key % b.ACCOUNTS_PER_OWNER).cast("int").alias("slot"),
        F.inline(
            F.array(
                F.struct(F.lit("name").alias("field"), F.when(key % 3 == 0, F.col("c_name")).otherwise(" ").alias("value")),
                F.struct(F.lit("segment").alias("field"), F.when(key % 6 == 0, F.col("c_mktsegment")).otherwise("").alias("value")),
                F.struct(F.lit("balance").alias("field"), F.when(F.col("c_acctbal") > 9000, "x").otherwise("").alias("value")),
            )
        ),
        F.lit(False).alias("read_only"), F.lit(True).alias("editable"),
    )
    personal = c.select(
        owner, F.lit("personal").alias("section"), F.lit(None).cast("string").alias("entity"), F.lit(0).alias("slot"),
        F.concat(F.lit("field"), key % 5).alias("field"),
        F.when(F.col("c_nationkey") % 2 == 0, "set").otherwise("").alias("value"),
        (key % 7 == 0).alias("read_only"), F.lit(True).alias("editable"),
    )
    return slots.select(*personal.columns).unionByName(personal)


SQL_SECTIONS = f"""
sections AS (
  SELECT owner_id, section, editable,
    CASE WHEN count(*) = 0 THEN 100 ELSE {b.sql_round("count(*) FILTER (WHERE trim(value) <> '')::DOUBLE / count(*)::DOUBLE * 100")} END AS pct
  FROM (SELECT *, bool_or(trim(value) <> '') OVER (PARTITION BY owner_id, section, entity, slot) AS started FROM fields WHERE NOT read_only)
  WHERE entity IS NULL OR slot = 0 OR started GROUP BY ALL)"""


@query("profile_completeness", b.with_ctes(SQL_FIELDS, SQL_SECTIONS, select="SELECT * FROM sections"))
def profile_completeness(spark, sf_dir):
    return r.profile_completeness(profile_fields(spark, sf_dir))


@query(
    "profile_overall",
    b.with_ctes(SQL_FIELDS, SQL_SECTIONS, select=f"SELECT owner_id, {b.sql_round('avg(pct)')} AS overall FROM sections WHERE editable GROUP BY ALL"),
)
def profile_overall(spark, sf_dir):
    return r.profile_overall(r.profile_completeness(profile_fields(spark, sf_dir)))
