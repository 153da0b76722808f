"""Ledger-shaped views over the benchmark tables, in Spark and as DuckDB CTE text.

The operators know nothing of these tables: this module is the only place that maps
orders, line items, events, documents, embeddings, pages and conversations to the
ledger schema, and the CTE text states the same mapping for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.functions import period, text

ACCOUNTS_PER_OWNER = 30
COLORS = ["blue", "new", "cold", "small", "hot", "old", "red", "large"]
GOODS = ["ring", "bolt", "plate", "rod", "gear", "gizmo", "anvil", "widget"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def minor(value: Column) -> Column:
    return F.round(value * 100).cast("bigint")


# ----------------------------------------------------------------------------- orders
RAILS = {"1-URGENT": "UPI", "2-HIGH": "IMPS", "3-MEDIUM": "NEFT", "4-NOT SPECIFIED": "POS", "5-LOW": "ACH"}


def sql_capped(made: str, limit: int) -> str:
    """An identifier that is shortened where it is over the limit."""
    return f"CASE WHEN length({made}) <= {limit} THEN {made} ELSE substr({made}, 1, {limit - 17}) || '_' || substr(sha256({made}), 1, 16) END"


def ledger_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per order: account = customer, document = customer-year."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    date = F.to_date("o_orderdate")
    rail = text.literal_map(RAILS)[F.col("o_orderpriority")]
    shop = F.translate(F.col("o_custkey").cast("string"), "0123456789", "abcdefghij")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .select(
            F.floor(F.col("o_custkey") / ACCOUNTS_PER_OWNER).cast("bigint").alias("owner_id"),
            F.concat(F.lit("o"), F.col("o_orderkey")).alias("txn_id"),
            F.concat(F.lit("stmt_"), F.col("o_custkey"), F.lit("_"), F.year(date)).alias("document_id"),
            F.concat(F.lit("inst_"), F.col("c_nationkey")).alias("institution_id"),
            F.concat(F.lit("acc_"), F.col("o_custkey")).alias("own_account_id"),
            F.when(F.col("o_custkey") % 4 == 0, "card").otherwise("bank").alias("own_account_kind"),
            date.alias("txn_date"),
            (minor(F.col("o_totalprice")) * F.when(F.col("o_orderstatus") == "P", 1).otherwise(-1)).alias("amount"),
            F.concat(
                rail, F.lit("/"), F.col("o_orderkey"), F.lit("/SHOP "), shop, F.lit("/"), F.col("c_mktsegment")
            ).alias("raw_description"),
            F.col("o_orderkey").alias("seq"),
            period.fy_key(date).alias("fy_key"),
        )
    )


def sql_case(column: str, mapping: dict[str, str]) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {arms} END"


def sql_fy(date: str) -> str:
    year = f"(CASE WHEN month({date}) < 4 THEN year({date}) - 1 ELSE year({date}) END)"
    return f"({year} || '-' || lpad((({year} + 1) % 100)::VARCHAR, 2, '0'))"


SQL_ORDERS = f"""
ledger_orders AS (
  SELECT CAST(floor(o_custkey / {ACCOUNTS_PER_OWNER}) AS BIGINT) AS owner_id,
         'o' || o_orderkey AS txn_id,
         'stmt_' || o_custkey || '_' || year(o_orderdate) AS document_id,
         'inst_' || c_nationkey AS institution_id,
         'acc_' || o_custkey AS own_account_id,
         CASE WHEN o_custkey % 4 = 0 THEN 'card' ELSE 'bank' END AS own_account_kind,
         o_orderdate::DATE AS txn_date,
         round(o_totalprice * 100)::BIGINT * CASE WHEN o_orderstatus = 'P' THEN 1 ELSE -1 END AS amount,
         {sql_case('o_orderpriority', RAILS)} || '/' || o_orderkey || '/SHOP '
           || translate(o_custkey::VARCHAR, '0123456789', 'abcdefghij') || '/' || c_mktsegment AS raw_description,
         o_orderkey AS seq,
         {sql_fy('o_orderdate::DATE')} AS fy_key
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""

# ------------------------------------------------------------------------- line items
CATEGORY_OF_TYPE = {
    "ECONOMY": "Loan", "MEDIUM": "Insurance", "PROMO": "Investment",
    "LARGE": "Ott", "SMALL": "Groceries", "STANDARD": "Housing",
}
SECTION_OF_TYPE = {
    "ECONOMY": "24b", "MEDIUM": "80D", "PROMO": "80C", "LARGE": "80c", "SMALL": "other", "STANDARD": "80ccd1b",
}
WORD_OF_LINE = {
    "1": "electricity", "2": "gas station", "3": "card payment", "4": "refund", "5": "interest",
    "6": "premium", "7": "store",
}


def ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One already classified transaction per line item."""
    line = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    date = F.to_date("l_shipdate")
    refund = F.col("l_returnflag") == "R"
    internal = (F.col("p_type") == "LARGE") & (F.col("l_linestatus") == "O") & (F.col("l_linenumber") <= 2)
    flow = (
        F.when(internal, "transfer")
        .when(refund, "income")
        .when(F.col("p_type") == "PROMO", "investment")
        .otherwise("expense")
    )
    category = (
        F.when(internal, "Transfer")
        .when(refund & (F.col("p_type") == "ECONOMY"), "Salary")
        .when(refund, "Income")
        .when(F.col("l_linenumber") == 7, "Uncategorised")
        .otherwise(text.literal_map(CATEGORY_OF_TYPE)[F.col("p_type")])
    )
    layer = (
        F.when(F.col("l_linenumber") == 7, 7).when(F.col("p_size") % 5 == 0, 5).when(F.col("p_size") % 5 == 1, 2)
        .when(F.col("p_size") % 5 == 2, 1).otherwise(4)
    )
    owner = F.floor(F.col("o_custkey") / ACCOUNTS_PER_OWNER).cast("bigint")
    return (
        line.join(o, line.l_orderkey == o.o_orderkey)
        .join(p, line.l_partkey == p.p_partkey)
        .join(s, line.l_suppkey == s.s_suppkey)
        .select(
            owner.alias("owner_id"),
            F.concat_ws(
                "_", F.concat(F.lit("t"), F.col("l_orderkey")), "l_linenumber", "l_partkey", "l_suppkey",
                F.date_format("l_shipdate", "yyyyMMdd"),
            ).alias("txn_id"),
            F.concat(F.lit("doc_"), F.col("o_custkey"), F.lit("_"), F.year(date)).alias("document_id"),
            F.concat(F.lit("m"), F.col("l_orderkey") % 300).alias("message_id"),
            F.when(F.col("p_size") % 9 != 0, F.col("s_name")).alias("institution_id"),
            F.when(F.col("o_custkey") % 11 != 0, F.concat(F.lit("acc_"), F.col("o_custkey"))).alias("own_account_id"),
            F.when(F.col("o_custkey") % 11 != 0, F.when(F.col("o_custkey") % 4 == 0, "card").otherwise("bank")).alias(
                "own_account_kind"
            ),
            date.alias("txn_date"),
            (minor(F.col("l_extendedprice")) * F.when(refund, 1).otherwise(-1)).alias("amount"),
            F.lit("INR").alias("currency"),
            F.concat(
                F.when(F.col("l_returnflag") == "N", "UPI").otherwise("POS"), F.lit("/"), F.col("l_orderkey"),
                F.lit("/"), F.col("p_name"), F.lit(" "),
                text.literal_map(WORD_OF_LINE)[F.col("l_linenumber").cast("string")], F.lit("/"), F.col("s_name"),
            ).alias("raw_description"),
            F.concat(F.lit("pay"), F.col("l_suppkey"), F.lit("@okbank")).alias("counterparty_raw"),
            flow.alias("flow"),
            category.alias("category"),
            F.when(F.col("p_size") % 6 == 0, F.lit(None))
            .when((F.col("p_type") == "STANDARD") & (F.col("p_size") % 6 == 1), "Rent")
            .otherwise(F.col("p_name")).cast("string").alias("subcategory"),
            F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("merchant"),
            F.when(F.col("l_linenumber") == 7, "low").when(F.col("l_linenumber") == 6, "med").otherwise("high").alias(
                "confidence"
            ),
            F.concat(F.lit("rule "), F.col("p_type")).alias("reason"),
            F.when(F.col("l_linenumber") != 7, F.concat(F.lit("signal."), F.lower("p_type"))).alias("signal"),
            layer.cast("int").alias("layer"),
            ((F.col("l_linenumber") == 7) | ((F.col("l_linenumber") == 6) & (F.col("l_linestatus") == "O"))).alias(
                "review_required"
            ),
            internal.alias("is_internal_transfer"),
            ((F.col("p_type") == "LARGE") & ~refund).alias("is_recurring"),
            F.when(F.col("p_size") == 50, F.concat(F.lit("proj_"), owner)).alias("project_id"),
            F.when(F.col("p_size") % 4 == 0, text.literal_map(SECTION_OF_TYPE)[F.col("p_type")]).alias("tax_section"),
            (refund & (F.col("l_quantity") >= 48)).alias("suspected_transfer"),
            F.when(F.col("p_size") % 5 == 0, "local_ml").otherwise("deterministic").alias("source"),
            F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("pred_"), F.col("l_orderkey"))).alias(
                "accepted_prediction_id"
            ),
            period.fy_key(date).alias("fy_key"),
        )
    )


SQL_LINES = f"""
ledger_lines AS (
  SELECT *, {sql_fy('txn_date')} AS fy_key FROM (
  SELECT CAST(floor(o_custkey / {ACCOUNTS_PER_OWNER}) AS BIGINT) AS owner_id,
         concat_ws('_', 't' || l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS txn_id,
         'doc_' || o_custkey || '_' || year(l_shipdate) AS document_id,
         'm' || (l_orderkey % 300) AS message_id,
         CASE WHEN p_size % 9 <> 0 THEN s_name END AS institution_id,
         CASE WHEN o_custkey % 11 <> 0 THEN 'acc_' || o_custkey END AS own_account_id,
         CASE WHEN o_custkey % 11 = 0 THEN NULL WHEN o_custkey % 4 = 0 THEN 'card' ELSE 'bank' END AS own_account_kind,
         l_shipdate::DATE AS txn_date,
         round(l_extendedprice * 100)::BIGINT * CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS amount,
         'INR' AS currency,
         CASE WHEN l_returnflag = 'N' THEN 'UPI' ELSE 'POS' END || '/' || l_orderkey || '/' || p_name || ' '
           || {sql_case('l_linenumber::VARCHAR', WORD_OF_LINE)} || '/' || s_name AS raw_description,
         'pay' || l_suppkey || '@okbank' AS counterparty_raw,
         CASE WHEN p_type = 'LARGE' AND l_linestatus = 'O' AND l_linenumber <= 2 THEN 'transfer'
              WHEN l_returnflag = 'R' THEN 'income' WHEN p_type = 'PROMO' THEN 'investment' ELSE 'expense' END AS flow,
         CASE WHEN p_type = 'LARGE' AND l_linestatus = 'O' AND l_linenumber <= 2 THEN 'Transfer'
              WHEN l_returnflag = 'R' AND p_type = 'ECONOMY' THEN 'Salary' WHEN l_returnflag = 'R' THEN 'Income'
              WHEN l_linenumber = 7 THEN 'Uncategorised' ELSE {sql_case('p_type', CATEGORY_OF_TYPE)} END AS category,
         CASE WHEN p_size % 6 = 0 THEN NULL WHEN p_type = 'STANDARD' AND p_size % 6 = 1 THEN 'Rent' ELSE p_name END AS subcategory,
         CASE WHEN p_size % 7 <> 0 THEN p_brand END AS merchant,
         CASE l_linenumber WHEN 7 THEN 'low' WHEN 6 THEN 'med' ELSE 'high' END AS confidence,
         'rule ' || p_type AS reason,
         CASE WHEN l_linenumber <> 7 THEN 'signal.' || lower(p_type) END AS signal,
         CASE WHEN l_linenumber = 7 THEN 7 WHEN p_size % 5 = 0 THEN 5 WHEN p_size % 5 = 1 THEN 2
              WHEN p_size % 5 = 2 THEN 1 ELSE 4 END AS layer,
         (l_linenumber = 7 OR (l_linenumber = 6 AND l_linestatus = 'O')) AS review_required,
         (p_type = 'LARGE' AND l_linestatus = 'O' AND l_linenumber <= 2) AS is_internal_transfer,
         (p_type = 'LARGE' AND l_returnflag <> 'R') AS is_recurring,
         CASE WHEN p_size = 50 THEN 'proj_' || CAST(floor(o_custkey / {ACCOUNTS_PER_OWNER}) AS BIGINT) END AS project_id,
         CASE WHEN p_size % 4 = 0 THEN {sql_case('p_type', SECTION_OF_TYPE)} END AS tax_section,
         (l_returnflag = 'R' AND l_quantity >= 48) AS suspected_transfer,
         CASE WHEN p_size % 5 = 0 THEN 'local_ml' ELSE 'deterministic' END AS source,
         CASE WHEN p_size % 5 = 0 THEN 'pred_' || l_orderkey END AS accepted_prediction_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
       JOIN supplier ON l_suppkey = s_suppkey)
)"""


# ------------------------------------------------------------------ messages, accounts
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        F.concat(F.lit("m"), F.col("page_id")).alias("message_id"),
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("from_addr"),
        F.concat(F.lit("Statement "), F.col("page_id")).alias("subject"),
        F.concat(F.lit("run_"), F.col("page_id") % 7).alias("run_id"),
        F.col("url"),
        F.length("html").cast("bigint").alias("bytes"),
    )


SQL_MESSAGES = """
messages AS (
  SELECT 'm' || page_id AS message_id, regexp_extract(url, '^https?://([^/]+)', 1) AS from_addr,
         'Statement ' || page_id AS subject, 'run_' || (page_id % 7) AS run_id, url,
         length(html)::BIGINT AS bytes
  FROM pages
)"""


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered accounts; every 13th customer has none, so its rows are orphaned."""
    c = table(spark, sf_dir, "customer").filter("c_custkey % 13 <> 0")
    return c.select(
        F.floor(F.col("c_custkey") / ACCOUNTS_PER_OWNER).cast("bigint").alias("owner_id"),
        F.concat(F.lit("acc_"), F.col("c_custkey")).alias("account_id"),
        F.when(F.col("c_custkey") % 4 == 0, "card").otherwise("bank").alias("kind"),
        F.concat(F.lit("inst_"), F.col("c_nationkey"), F.when(F.col("c_custkey") % 4 == 0, "-cards").otherwise("")).alias(
            "institution_id"
        ),
        F.when(F.col("c_custkey") % 6 != 0, F.lpad((F.col("c_custkey") * 7 % 10000).cast("string"), 4, "0")).alias("last4"),
        F.col("c_name").alias("nickname"),
    )


SQL_ACCOUNTS = f"""
accounts AS (
  SELECT CAST(floor(c_custkey / {ACCOUNTS_PER_OWNER}) AS BIGINT) AS owner_id, 'acc_' || c_custkey AS account_id,
         CASE WHEN c_custkey % 4 = 0 THEN 'card' ELSE 'bank' END AS kind,
         'inst_' || c_nationkey || CASE WHEN c_custkey % 4 = 0 THEN '-cards' ELSE '' END AS institution_id,
         CASE WHEN c_custkey % 6 <> 0 THEN lpad((c_custkey * 7 % 10000)::VARCHAR, 4, '0') END AS last4,
         c_name AS nickname
  FROM customer WHERE c_custkey % 13 <> 0
)"""


# ------------------------------------------------------------------------ SQL assembly
SQL_BLANKS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def sql_clean(column: str) -> str:
    return f"trim(regexp_replace(lower({column}), '{SQL_BLANKS}', ' ', 'g'))"


def sql_signature(column: str) -> str:
    out = f"regexp_replace({sql_clean(column)}, '\\b[0-9x*·]{{4,}}\\b', ' ', 'g')"
    out = f"regexp_replace({out}, '[0-9]+', ' ', 'g')"
    out = f"regexp_replace({out}, '[^a-z ]+', ' ', 'g')"
    out = f"regexp_replace({out}, '\\b(upi|imps|neft|rtgs|ref|txn|id|no|dt|inr|rs)\\b', ' ', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def sql_round(value: str) -> str:
    return f"CAST(floor(({value}) + 0.5) AS BIGINT)"


def sql_major(value: str) -> str:
    return f"CAST(floor((coalesce({value}, 0) + 50) / 100.0) AS BIGINT)"


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select.strip()
