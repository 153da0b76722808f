"""Statement parsing, packs, landing tables and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import money, period, text
from ledgerloom.operators import quality
from ledgerloom.plans import bindings as b
from ledgerloom.plans.integrity_queries import on_statements, statement_rows
from ledgerloom.plans.registry import query
from ledgerloom.plans.rollup_queries import SQL_ATTACHMENTS, attachments, on_lines, sql_bytes
from ledgerloom.plans.rule_queries import sql_normalized
from ledgerloom.sources import landing, packs, statements

OPENING = 1_000_000_000_000


# ----------------------------------------------------------------------- statement text
def statement_text(spark, sf_dir):
    """Each customer-year as the text of a statement with running balances, ten years later."""
    from pyspark.sql import Window

    rows = b.ledger_orders(spark, sf_dir).withColumn("day", F.add_months("txn_date", 120))
    order = Window.partitionBy("owner_id", "document_id").orderBy("txn_date", "seq")
    balance = F.lit(OPENING) + F.sum("amount").over(order)

    def shown(value):
        return (value.cast("decimal(20,0)") / 100).cast("decimal(20,2)").cast("string")

    main = F.concat_ws(" ", F.date_format("day", "dd/MM/yyyy"), F.col("raw_description"), shown(F.abs("amount")), shown(balance))
    orphan = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("\nUPI/late note "), "seq")).otherwise("")
    wrapped = F.when(F.col("seq") % 7 == 0, F.concat(F.lit("\nwrapped part "), "own_account_kind")).otherwise("")
    lines = rows.select(
        "owner_id", "document_id", "own_account_id", "txn_date", "seq", F.concat(main, wrapped, orphan).alias("line")
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("txn_date", "seq", "line"))), lambda x: x["line"]), "\n")
    number = F.lpad((F.substr("own_account_id", F.lit(5)).cast("bigint") * 7 % 10000).cast("string"), 4, "0")
    card = F.substr("own_account_id", F.lit(5)).cast("bigint") % 4 == 0
    docs = lines.groupBy("owner_id", "document_id", "own_account_id").agg(body.alias("body"))
    top = F.concat(
        F.when(card, "Your Credit Card Statement\r\n").otherwise("Statement for the year\r\n"),
        F.when(card, F.concat(F.lit("4375XXXXXXXX"), number)).otherwise(F.concat(F.lit("A/c No: XXXXXX"), number)), F.lit("\n"),
        F.lit("Date  Details\tAmount  Balance\n01/04/2005 Opening Balance 10,000,000,000.00\n"),
    )
    return docs.select(
        "owner_id", "document_id", F.concat(top, "body", F.lit("\n31/03/2012 Grand Total 12.00 13.00\n")).alias("text"),
        F.lit(OPENING).alias("opening_balance"), F.lit("bank_statement").alias("doc_type"), F.lit("any").alias("provider_id"),
    )


SQL_STATEMENT = """
lines AS (SELECT *, lag(seq) OVER w AS earlier, lead(seq) OVER w AS later,
    (row_number() OVER w - 1) AS number FROM ledger_orders WINDOW w AS (PARTITION BY owner_id, document_id ORDER BY txn_date, seq)),
expected AS (SELECT owner_id, document_id, 'txn_' || document_id || '_' || number AS txn_id, (txn_date + INTERVAL 120 MONTH)::DATE AS txn_date, amount,
  raw_description || CASE WHEN earlier % 5 = 0 THEN ' UPI/late note ' || earlier ELSE '' END || CASE WHEN seq % 7 = 0 THEN ' wrapped part ' || own_account_kind ELSE '' END AS raw_description FROM lines)"""


@query("statement_rows", b.with_ctes(b.SQL_ORDERS, SQL_STATEMENT, select="SELECT * FROM expected"))
def statement_rows_query(spark, sf_dir):
    """Round trip: the parsed text must give back the ledger it was written from."""
    parsed = statements.transactions(statements.parse_with(statement_text(spark, sf_dir)))
    return parsed.select("owner_id", "document_id", "txn_id", "txn_date", "amount", "raw_description")


@query(
    "statement_parsers",
    b.with_ctes(
        b.SQL_ORDERS, SQL_STATEMENT,
        select="""SELECT owner_id, document_id, txn_id, amount, CASE owner_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'INR' END AS currency FROM expected""",
    ),
)
def statement_parsers(spark, sf_dir):
    """Documents go to the parser of their provider and type, of their type alone, or to the default."""

    def in_currency(code):
        return lambda documents: statements.parse_statements(documents).withColumn("currency", F.lit(code))

    third = F.col("owner_id") % 3
    documents = statement_text(spark, sf_dir).withColumns(
        {
            "provider_id": F.when(third == 0, "dollar").otherwise(F.col("provider_id")),
            "doc_type": F.when(third == 1, "passbook").otherwise(F.col("doc_type")),
        }
    )
    parsers = {"dollar:bank_statement": in_currency("USD"), "*:passbook": in_currency("EUR"), "dollar:passbook": in_currency("GBP")}
    parsed = statements.transactions(statements.parse_with(documents, parsers))
    return parsed.select("owner_id", "document_id", "txn_id", "amount", "currency")


@query(
    "statement_rejects",
    b.with_ctes(
        b.SQL_ORDERS, SQL_STATEMENT,
        select="""SELECT document_id, 'furniture' AS reject, '01/04/2005 Opening Balance 10,000,000,000.00' AS raw FROM (SELECT DISTINCT document_id FROM lines)
        UNION ALL SELECT document_id, 'furniture', '31/03/2012 Grand Total 12.00 13.00' || CASE WHEN seq % 5 = 0 THEN ' UPI/late note ' || seq ELSE '' END FROM lines WHERE later IS NULL""",
    ),
)
def statement_rejects(spark, sf_dir):
    return statements.rejects(statements.parse_statements(statement_text(spark, sf_dir))).select("document_id", "reject", "raw")


@query(
    "statement_header",
    b.with_ctes(
        b.SQL_ORDERS,
        select="""SELECT DISTINCT document_id, lpad((substr(own_account_id, 5)::BIGINT * 7 % 10000)::VARCHAR, 4, '0') AS account_last4,
        CASE WHEN own_account_kind = 'card' THEN 'card_statement' ELSE 'bank_statement' END AS doc_type FROM ledger_orders""",
    ),
)
def statement_header(spark, sf_dir):
    return statements.header_facts(statement_text(spark, sf_dir)).select("document_id", "account_last4", "doc_type")


@query("document_parse")
def document_parse(spark, sf_dir):
    """Free text with planted amounts has no layout an independent SQL could restate; see the tests."""
    docs = b.table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 50).alias("owner_id"), F.concat(F.lit("doc_"), "doc_id").alias("document_id"),
        F.concat(F.lit("05/06/2011 "), F.regexp_replace("text", r"\n", "\n06/06/2011 12.50 ")).alias("text"),
        F.lit(None).cast("bigint").alias("opening_balance"), F.lit("bank_statement").alias("doc_type"),
    )
    return statements.parse_statements(docs).groupBy("document_id", "reject").agg(F.count("*").alias("rows"))


# -------------------------------------------------------------------------------- packs
def pack_files(spark, sf_dir):
    """One pack file per nation; suppliers are its merchants and every tenth one also a provider."""
    s = b.table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    entry = F.struct(
        F.concat(F.lit("sup-"), key % 60).alias("id"), F.col("s_name").alias("display_name"),
        F.when(key % 8 != 0, F.concat(F.col("s_name"), F.lit(" Ltd"))).alias("legal_name"),
        F.lit("merchant").alias("category"), F.lit(None).cast("string").alias("type"),
        F.array(F.lit("abc"), F.concat(F.lit("Shop No "), key), F.col("s_name"), F.when(key % 9 == 0, " ").otherwise("Corner")).alias("aliases"),
        F.when(
            key % 7 != 0,
            F.array(
                F.struct(
                    F.when(key % 5 != 0, "list").otherwise("").alias("name"),
                    F.when(key % 4 != 0, "https://example.org").otherwise("http://example.org").alias("url"),
                    F.when(key % 3 != 0, "official").otherwise("rumour").alias("source_type"),
                    F.when(key % 6 != 0, "2024-01-01").otherwise("1 Jan 2024").alias("retrieved_at"),
                )
            ),
        ).otherwise(F.array().cast("array<struct<name:string,url:string,source_type:string,retrieved_at:string>>")).alias("sources"),
        F.when(key % 4 == 0, "medium").when(key % 4 == 1, "low").when(key % 4 == 2, "high").otherwise("sure").alias("confidence"),
        F.when(key % 11 != 0, "active").alias("status"), F.concat(F.lit("nation-"), key % 30).alias("issuer_id"),
    ).cast(packs.ROW)
    files = s.groupBy("s_nationkey").agg(
        F.array_sort(F.collect_list(F.struct("s_suppkey", entry.alias("row")))).alias("rows")
    )
    merchants = F.transform("rows", lambda x: x["row"])
    providers = F.transform(F.filter("rows", lambda x: x["s_suppkey"] % 10 == 0), lambda x: x["row"])
    nothing = F.array().cast(f"array<{packs.ROW}>")
    return files.select(
        F.lpad(F.col("s_nationkey").cast("string"), 3, "0").alias("file"), F.lit("v1").alias("version"),
        F.when(F.col("s_nationkey") % 3 == 0, "misc").otherwise(F.concat(F.lit("expenses.shops.n"), "s_nationkey")).alias("category"),
        providers.alias("providers"), nothing.alias("issuers"), nothing.alias("products"), merchants.alias("merchants"),
    )


SQL_PACKS = """
entries AS (SELECT lpad(s_nationkey::VARCHAR, 3, '0') AS file, s_nationkey, s_suppkey AS key, 'sup-' || (s_suppkey % 60) AS id, s_name AS display_name,
    ['abc', 'Shop No ' || s_suppkey, s_name, CASE WHEN s_suppkey % 9 = 0 THEN ' ' ELSE 'Corner' END] AS aliases,
    CASE s_suppkey % 4 WHEN 0 THEN 'med' WHEN 1 THEN 'low' ELSE 'high' END AS confidence FROM supplier),
names AS (SELECT *, unnest(['Shop No ' || key, display_name, CASE WHEN key % 9 <> 0 THEN 'Corner' END]) AS alias, unnest([2, 1, 3]) AS no FROM entries),
aliases AS (SELECT id || ':' || trim(regexp_replace(lower(alias), '[^a-z0-9]+', '-', 'g'), '-') AS alias_id, lower(alias) AS pattern, display_name AS canonical_merchant,
    CASE WHEN s_nationkey % 3 = 0 THEN 'misc' ELSE 'expenses.shops' END AS category, CASE WHEN s_nationkey % 3 <> 0 THEN 'n' || s_nationkey END AS subcategory, 'pack:in' AS source, confidence, file, key, no
  FROM names WHERE alias IS NOT NULL),
latest AS (SELECT alias_id, pattern, canonical_merchant, category, subcategory, source, confidence FROM aliases QUALIFY row_number() OVER (PARTITION BY alias_id ORDER BY file DESC, key DESC, no DESC) = 1),
places AS (SELECT id, display_name, confidence, file, key FROM entries QUALIFY row_number() OVER (PARTITION BY id ORDER BY file DESC, key DESC) = 1)"""


@query("pack_aliases", b.with_ctes(SQL_PACKS, select="SELECT * FROM latest"))
def pack_aliases(spark, sf_dir):
    return packs.merchant_aliases(pack_files(spark, sf_dir))


@query("pack_institutions", b.with_ctes(SQL_PACKS, select="SELECT id, display_name, confidence, 'pack:in' AS source FROM places"))
def pack_institutions(spark, sf_dir):
    return packs.institutions(pack_files(spark, sf_dir)).select("id", "display_name", "confidence", "source")


@query(
    "reference_upsert",
    b.with_ctes(
        SQL_PACKS,
        """stored AS (SELECT alias_id, 'old ' || pattern AS pattern, CASE WHEN key % 3 = 0 THEN 'user' ELSE 'pack:in' END AS source FROM (SELECT * FROM aliases QUALIFY row_number() OVER (PARTITION BY alias_id ORDER BY file DESC, key DESC, no DESC) = 1) WHERE key % 2 = 0
          UNION ALL SELECT 'gone-' || id, 'x', CASE WHEN key % 2 = 0 THEN 'user' ELSE 'pack:in' END FROM places)""",
        select="""SELECT coalesce(s.alias_id, l.alias_id) AS alias_id, CASE WHEN s.source = 'user' THEN s.pattern ELSE l.pattern END AS pattern, coalesce(s.source, l.source) AS source
        FROM stored s FULL JOIN latest l USING (alias_id) WHERE s.source = 'user' OR l.alias_id IS NOT NULL""",
    ),
)
def reference_upsert(spark, sf_dir):
    loaded = packs.merchant_aliases(pack_files(spark, sf_dir)).select("alias_id", "pattern", "source", "canonical_merchant")
    key = F.regexp_extract("canonical_merchant", "#0*([0-9]+)$", 1).cast("bigint")
    known = loaded.filter(key % 2 == 0).select(
        "alias_id", F.concat(F.lit("old "), "pattern").alias("pattern"), F.when(key % 3 == 0, "user").otherwise(fv.PACK_SOURCE).alias("source"), "canonical_merchant"
    )
    gone = packs.institutions(pack_files(spark, sf_dir)).select(
        F.concat(F.lit("gone-"), "id").alias("alias_id"), F.lit("x").alias("pattern"),
        F.when(F.regexp_extract("display_name", "#0*([0-9]+)$", 1).cast("bigint") % 2 == 0, "user").otherwise(fv.PACK_SOURCE).alias("source"),
        F.col("display_name").alias("canonical_merchant"),
    )
    return packs.load(known.unionByName(gone), loaded, "alias_id", purge=True).select("alias_id", "pattern", "source")


@query(
    "pack_quality",
    """WITH e AS (SELECT s_suppkey AS key, 'sup-' || (s_suppkey % 60) AS id FROM supplier)
    SELECT label, violation, count(*)::BIGINT AS rows FROM (
      SELECT id AS label, 'missing legal_name' AS violation FROM e WHERE key % 8 = 0
      UNION ALL SELECT id, 'empty alias' FROM e WHERE key % 9 = 0
      UNION ALL SELECT id, 'confidence domain' FROM e WHERE key % 4 = 3
      UNION ALL SELECT id, 'status domain' FROM e WHERE key % 11 = 0
      UNION ALL SELECT id, 'no sources' FROM e WHERE key % 7 = 0
      UNION ALL SELECT id || '.sources[0]', 'missing source name' FROM e WHERE key % 7 <> 0 AND key % 5 = 0
      UNION ALL SELECT id || '.sources[0]', 'url is not https' FROM e WHERE key % 7 <> 0 AND key % 4 = 0
      UNION ALL SELECT id || '.sources[0]', 'source type domain' FROM e WHERE key % 7 <> 0 AND key % 3 = 0
      UNION ALL SELECT id || '.sources[0]', 'retrieved_at format' FROM e WHERE key % 7 <> 0 AND key % 6 = 0
      UNION ALL SELECT id, 'duplicate id' FROM e GROUP BY id HAVING count(*) > 1
      UNION ALL SELECT id, 'unknown issuer_id' FROM e WHERE key % 30 NOT IN (SELECT n_nationkey FROM nation)) GROUP BY ALL""",
)
def pack_quality(spark, sf_dir):
    rows = pack_files(spark, sf_dir).select(F.explode("merchants").alias("row")).select("row.*")
    nations = b.table(spark, sf_dir, "nation").select(F.concat(F.lit("nation-"), "n_nationkey").alias("id"))
    found = quality.validate_seed_rows(rows).unionByName(quality.duplicate_ids(rows)).unionByName(quality.unknown_references(rows, "issuer_id", nations))
    return found.groupBy("label", "violation").agg(F.count("*").alias("rows"))


@query(
    "template_quality",
    """SELECT label, violation FROM (
      SELECT CASE WHEN page_id % 9 = 0 THEN 'Bad Id ' || page_id ELSE 'tpl-' || page_id END AS label, page_id FROM pages) t,
      LATERAL (SELECT unnest([CASE WHEN page_id % 9 = 0 THEN 'id is not a slug' END, CASE WHEN page_id % 7 = 0 THEN 'missing mandatory fragment' END,
        CASE WHEN page_id % 5 = 0 THEN 'missing doc_type' END, CASE WHEN page_id % 4 = 0 THEN 'empty entry in sender_hints' END, CASE WHEN page_id % 30 >= 25 THEN 'unknown provider_id' END]) AS violation) v
      WHERE violation IS NOT NULL""",
)
def template_quality(spark, sf_dir):
    key = F.col("page_id")
    some = F.array(F.lit("x"))
    templates = b.table(spark, sf_dir, "pages").select(
        F.when(key % 9 == 0, F.concat(F.lit("Bad Id "), key)).otherwise(F.concat(F.lit("tpl-"), key)).alias("id"),
        F.concat(F.lit("nation-"), key % 30).alias("provider_id"), F.when(key % 5 != 0, "bank_statement").otherwise(" ").alias("doc_type"),
        F.array(F.when(key % 4 != 0, F.col("url")).otherwise("")).alias("sender_hints"), some.alias("subject_hints"),
        F.array(F.lit("-in:spam"), F.when(key % 7 != 0, "-in:trash").otherwise("has:attachment")).alias("query_fragments"),
        some.alias("attachment_mime_hints"), some.alias("password_rule_tags"),
    )
    nations = b.table(spark, sf_dir, "nation").select(F.concat(F.lit("nation-"), "n_nationkey").alias("id"))
    return quality.validate_templates(templates, nations)


# ------------------------------------------------------------------------------- landing
def providers_of(spark, sf_dir):
    return b.messages(spark, sf_dir).withColumn("provider_id", F.concat(F.lit("prov_"), F.length("url") % 5))


@query(
    "pending_scan",
    b.with_ctes(
        b.SQL_MESSAGES, SQL_ATTACHMENTS,
        select="SELECT attachment_id, a.message_id, CASE WHEN m.message_id IS NOT NULL THEN 'prov_' || (length(url) % 5) END AS provider_id FROM attachments a LEFT JOIN messages m ON m.message_id = a.message_id WHERE status = 'pending'",
    ),
)
def pending_scan(spark, sf_dir):
    return landing.pending_scan(attachments(spark, sf_dir), providers_of(spark, sf_dir)).select("attachment_id", "message_id", "provider_id")


@query(
    "content_dedup",
    """SELECT doc_id, sha256(text) AS sha256, 'att_' || substr(sha256(text), 1, 16) AS stored_id FROM documents
    WHERE doc_id % 3 <> 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0) QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
)
def content_dedup(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents")
    stored = docs.filter("doc_id % 3 = 0").select(F.sha2("text", 256).alias("sha256"))
    return landing.content_dedup(docs.filter("doc_id % 3 <> 0"), stored, F.col("text"), ["doc_id"]).select("doc_id", "sha256", "stored_id")


SQL_LISTINGS = """
listings AS (SELECT DISTINCT 'm' || (doc_id % 400) AS message_id, doc_id % 9 AS query_seq FROM documents)"""


def listings(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select(F.concat(F.lit("m"), F.col("doc_id") % 400).alias("message_id"), (F.col("doc_id") % 9).alias("query_seq")).distinct()


@query("multi_source_union_dedup", b.with_ctes(SQL_LISTINGS, select="SELECT message_id, min(query_seq) AS query_seq FROM listings GROUP BY 1"))
def multi_source_union_dedup(spark, sf_dir):
    return landing.first_match(listings(spark, sf_dir))


@query(
    "size_budget_gate",
    b.with_ctes(b.SQL_MESSAGES, select=f"SELECT run_id, bytes, bytes > 60000 AS required, {sql_bytes('bytes')} AS size FROM (SELECT run_id, sum(bytes)::BIGINT AS bytes FROM messages GROUP BY 1)"),
)
def size_budget_gate(spark, sf_dir):
    return landing.size_gate(b.messages(spark, sf_dir), ["run_id"], 60_000)


@query(
    "run_metrics",
    b.with_ctes(
        b.SQL_MESSAGES, SQL_ATTACHMENTS,
        select="""SELECT run_id, coalesce(messages, 0)::BIGINT AS messages, attachments, bytes, failed, CASE WHEN failed > 0 THEN 'error' ELSE 'done' END AS status
        FROM (SELECT run_id, count(*)::BIGINT AS attachments, sum(n_chars)::BIGINT AS bytes, count(*) FILTER (WHERE status = 'failed')::BIGINT AS failed FROM attachments GROUP BY 1)
        LEFT JOIN (SELECT run_id, count(*) AS messages FROM messages GROUP BY 1) USING (run_id)""",
    ),
)
def run_metrics(spark, sf_dir):
    return landing.run_metrics(b.messages(spark, sf_dir), attachments(spark, sf_dir))


# ------------------------------------------------------------------------------- scalars
@query(
    "fiscal_period",
    f"""SELECT o_orderkey, {b.sql_fy('o_orderdate::DATE')} AS fy_key, make_date((CASE WHEN month(o_orderdate) < 4 THEN year(o_orderdate) - 1 ELSE year(o_orderdate) END)::INT, 4, 1) AS starts,
    make_date((CASE WHEN month(o_orderdate) < 4 THEN year(o_orderdate) ELSE year(o_orderdate) + 1 END)::INT, 3, 31) AS ends FROM orders""",
)
def fiscal_period(spark, sf_dir):
    key = period.fy_key(F.to_date("o_orderdate"))
    window = period.fy_window(key)
    return b.table(spark, sf_dir, "orders").select("o_orderkey", key.alias("fy_key"), window["start"].alias("starts"), window["end"].alias("ends"))


@query(
    "add_cadence",
    "SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS monthly, (o_orderdate::DATE + INTERVAL 3 MONTH)::DATE AS quarterly, (o_orderdate::DATE + INTERVAL 12 MONTH)::DATE AS yearly FROM orders",
)
def add_cadence(spark, sf_dir):
    date = F.to_date("o_orderdate")
    return b.table(spark, sf_dir, "orders").select("o_orderkey", *[period.add_cadence(date, F.lit(c)).alias(c) for c in fv.CADENCE_MONTHS])


@query(
    "valid_date",
    """SELECT o_orderkey, CASE WHEN strftime(d, '%d')::INT <= day(last_day(make_date(y, m, 1))) THEN make_date(y, m, strftime(d, '%d')::INT) END AS made
    FROM (SELECT o_orderkey, o_orderdate::DATE AS d, 2000 + o_orderkey % 100 AS y, CASE WHEN o_orderkey % 13 = 0 THEN 2 ELSE month(o_orderdate) END AS m FROM orders)""",
)
def valid_date(spark, sf_dir):
    """Day and month of an order under another year and month, two-digit and four-digit."""
    key = F.col("o_orderkey")
    month = F.when(key % 13 == 0, "02").otherwise(F.date_format("o_orderdate", "MM"))
    year = F.lpad((key % 100).cast("string"), 2, "0")
    year = F.when(key % 2 == 0, year).otherwise(F.concat(F.lit("20"), year))
    return b.table(spark, sf_dir, "orders").select("o_orderkey", period.statement_date(F.date_format("o_orderdate", "dd"), month, year).alias("made"))


@query("amount_to_minor", "SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS minor FROM orders")
def amount_to_minor(spark, sf_dir):
    return b.table(spark, sf_dir, "orders").select("o_orderkey", money.to_minor(F.format_number("o_totalprice", 2)).alias("minor"))


@query(
    "to_major",
    b.with_ctes(b.SQL_ORDERS, select=f"SELECT txn_id, {b.sql_major('amount')} AS major, {b.sql_major('-amount')} AS negated, CAST(floor(amount / 200.0 + 0.5) AS BIGINT) AS halves FROM ledger_orders"),
)
def to_major(spark, sf_dir):
    amount = F.col("amount")
    return b.ledger_orders(spark, sf_dir).select(
        "txn_id", money.to_major(amount).alias("major"), money.to_major(-amount).alias("negated"), money.js_round(amount / 200).alias("halves")
    )


@query(
    "amount_near",
    b.with_ctes(b.SQL_ORDERS, select="SELECT txn_id, abs(abs(amount) - 20000000) <= 20000000 * 0.05 AS near, amount = 0 AS near_zero FROM ledger_orders"),
)
def amount_near(spark, sf_dir):
    return b.ledger_orders(spark, sf_dir).select(
        "txn_id", money.near(F.col("amount"), F.lit(20_000_000), 0.05).alias("near"), money.near(F.col("amount"), F.lit(0), 0.05).alias("near_zero")
    )


@query("human_bytes", f"SELECT o_orderkey, {sql_bytes('size')} AS size FROM (SELECT o_orderkey, (o_totalprice * (o_orderkey % 100000) * (o_orderkey % 7))::BIGINT AS size FROM orders)")
def human_bytes(spark, sf_dir):
    size = F.round(F.col("o_totalprice") * (F.col("o_orderkey") % 100_000) * (F.col("o_orderkey") % 7)).cast("bigint")
    return b.table(spark, sf_dir, "orders").select("o_orderkey", money.human_bytes(size).alias("size"))


@query("slug", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS whole, substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 48) AS capped FROM documents")
def slug(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", text.slug(F.col("text")).alias("whole"), text.slug(F.col("text"), 48).alias("capped"))


@query("clean_label")
def clean_label(spark, sf_dir):
    """Uses look-ahead, which the oracle's regular expressions lack; tested on fixtures."""
    return b.ledger_lines(spark, sf_dir).select("txn_id", text.clean_label(F.col("raw_description")).alias("label"))


WORDS = ["gas", "emi", "card payment", "rod", "sto"]


@query(
    "text_predicates",
    on_lines(
        "SELECT txn_id, "
        + ", ".join(f"contains({b.sql_clean('raw_description')}, '{w}') AS has_{i}, regexp_matches({b.sql_clean('raw_description')}, '\\b{w}\\b') AS word_{i}" for i, w in enumerate(WORDS))
        + f", contains({b.sql_clean('raw_description')}, 'gear') OR contains({b.sql_clean('raw_description')}, lower(merchant)) AS any_of FROM (SELECT * REPLACE (coalesce(merchant, '#') AS merchant) FROM ledger_lines)"
    ),
)
def text_predicates(spark, sf_dir):
    # cleaned once, out of a generator: as a plain column it would be put back into every question
    lines = b.ledger_lines(spark, sf_dir)
    rows = lines.select("txn_id", "merchant", F.inline(F.array(F.struct(text.clean(F.col("raw_description")).alias("cleaned")))))
    known = F.col("cleaned")
    columns = []
    for i, word in enumerate(WORDS):
        columns += [text.contains(known, F.lit(word), True).alias(f"has_{i}"), text.contains_word(known, F.lit(word), True).alias(f"word_{i}")]
    either = text.contains_any(known, F.array(F.lit("Gear"), F.coalesce("merchant", F.lit("#"))), True)
    return rows.select("txn_id", *columns, either.alias("any_of"))


@query(
    "taxonomy_labels",
    on_lines(
        f"""SELECT category, key, CASE key WHEN 'mobile_internet' THEN 'Mobile & Internet' WHEN 'cc_payment' THEN 'Credit Card Payment' WHEN 'atm_cash' THEN 'ATM / Cash'
          ELSE array_to_string(list_transform(string_split(key, '_'), lambda w: upper(w[1]) || w[2:]), ' ') END AS label, rows
        FROM (SELECT category, {sql_normalized('category')} AS key, count(*)::BIGINT AS rows FROM (
          SELECT CASE layer WHEN 1 THEN 'Mobile/Internet' WHEN 2 THEN 'ATM Withdrawal' WHEN 5 THEN 'quick-commerce' WHEN 7 THEN 'expenses.food_delivery' ELSE category END AS category FROM ledger_lines) GROUP BY ALL)"""
    ),
)
def taxonomy_labels(spark, sf_dir):
    layer = F.col("layer")
    given = (
        F.when(layer == 1, "Mobile/Internet").when(layer == 2, "ATM Withdrawal").when(layer == 5, "quick-commerce")
        .when(layer == 7, "expenses.food_delivery").otherwise(F.col("category"))
    )
    rows = b.ledger_lines(spark, sf_dir).groupBy(given.alias("category")).agg(F.count("*").alias("rows"))
    return rows.withColumn("key", text.normalize_category(F.col("category"))).withColumn("label", text.category_label(F.col("key")))


@query(
    "display_category",
    """SELECT DISTINCT p_name, p_type, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS shown,
    'expenses.' || replace(p_name, ' ', '_') AS category, lower(p_type) AS subcategory FROM part""",
)
def display_category(spark, sf_dir):
    dotted = F.concat(F.lit("expenses."), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), F.lower("p_type"))
    parts = text.split_taxonomy(dotted)
    return b.table(spark, sf_dir, "part").select(
        "p_name", "p_type", text.display_category(parts["category"], parts["subcategory"]).alias("shown"), parts["category"].alias("category"), parts["subcategory"].alias("subcategory")
    ).distinct()


@query(
    "flow_compatible",
    on_lines("SELECT txn_id, flow = 'transfer' OR CASE WHEN amount > 0 THEN flow = 'income' ELSE flow IN ('expense', 'investment') END AS rule_ok, flow <> 'transfer' AND CASE WHEN amount > 0 THEN flow = 'income' ELSE flow IN ('expense', 'investment') END AS label_ok FROM ledger_lines"),
)
def flow_compatible(spark, sf_dir):
    amount, flow = F.col("amount"), F.col("flow")
    return b.ledger_lines(spark, sf_dir).select(
        "txn_id", money.flow_fits_sign(amount, flow, True).alias("rule_ok"), money.flow_fits_sign(amount, flow, False).alias("label_ok")
    )


@query(
    "transfer_storage_category",
    on_lines("SELECT txn_id, CASE WHEN subcategory = 'cc_payment' THEN subcategory WHEN category IN ('Transfer', 'self_transfer', 'cc_payment', 'atm_cash') THEN category WHEN lower(flow) IN ('self_transfer') THEN flow ELSE 'Transfer' END AS stored FROM ledger_lines"),
)
def transfer_storage_category(spark, sf_dir):
    return b.ledger_lines(spark, sf_dir).select("txn_id", text.transfer_storage_category(F.col("flow"), F.col("category")).alias("stored"))


@query(
    "stable_ids",
    on_lines(
        "SELECT txn_id, CASE WHEN length(whole) <= 60 THEN made ELSE substr(made, 1, 43) || '_' || substr(sha256(whole), 1, 16) END AS stable_id "
        "FROM (SELECT txn_id, 'pred_' || raw_description || '_' || txn_id AS whole, regexp_replace(whole, '[^a-zA-Z0-9_-]', '_', 'g') AS made FROM ledger_lines)"
    ),
)
def stable_ids(spark, sf_dir):
    return b.ledger_lines(spark, sf_dir).select("txn_id", text.stable_id(60, "pred", F.col("raw_description"), F.col("txn_id")).alias("stable_id"))
