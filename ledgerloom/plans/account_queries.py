"""Account attribution and table-update queries."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.operators import accounts as acc
from ledgerloom.operators import partitions, quality, tables
from ledgerloom.plans import bindings as b
from ledgerloom.plans.integrity_queries import statement_rows
from ledgerloom.plans.registry import query
from ledgerloom.plans.rollup_queries import SQL_ATTACHMENTS, SQL_OPEN_ITEMS, attachments, on_lines, review_items
from ledgerloom.session import shared_folder, stored as written


# ------------------------------------------------------------------------------ documents
def documents(spark, sf_dir):
    """One statement per customer-year; numbers and institutions are partly missing or unknown."""
    rows = b.ledger_orders(spark, sf_dir)
    account = F.substr("own_account_id", F.lit(5)).cast("bigint")
    docs = rows.groupBy("owner_id", "document_id", "own_account_id").agg(
        F.count("*").alias("txn_count"), F.min("seq").alias("seq"), F.min("institution_id").alias("nation"), F.min(F.year("txn_date")).alias("year")
    )
    turn = account + F.col("year")
    return docs.select(
        "owner_id", "document_id", "seq",
        F.when(turn % 17 != 0, F.concat("nation", F.when(turn % 5 == 0, "-cards").otherwise(""))).alias("institution_id"),
        F.when(turn % 3 == 0, F.lit(None)).when(turn % 3 == 1, F.lpad((account * 7 % 10000).cast("string"), 4, "0"))
        .otherwise(F.lpad((account % 4).cast("string"), 4, "9")).alias("account_last4"),
        F.when(turn % 4 == 0, "card_statement").otherwise("bank_statement").alias("doc_type"),
        F.when(turn % 7 == 0, 0).otherwise(F.col("txn_count")).cast("bigint").alias("txn_count"),
        F.when(turn % 2 == 0, F.col("own_account_id")).alias("own_account_id"),
        F.when(turn % 2 == 0, F.when(account % 4 == 0, "card").otherwise("bank")).alias("own_account_kind"),
        F.when(turn % 8 == 0, "user_assigned").when(turn % 2 == 0, "header_match").alias("account_source"),
        F.concat(F.lit("att_"), F.col("seq") % 900).alias("attachment_id"),
    )


SQL_DOCUMENTS = """
documents_view AS (
  SELECT owner_id, document_id, seq, CASE WHEN turn % 17 <> 0 THEN nation || CASE WHEN turn % 5 = 0 THEN '-cards' ELSE '' END END AS institution_id,
    CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN lpad((account * 7 % 10000)::VARCHAR, 4, '0') ELSE lpad((account % 4)::VARCHAR, 4, '9') END AS account_last4,
    CASE WHEN turn % 4 = 0 THEN 'card_statement' ELSE 'bank_statement' END AS doc_type,
    CASE WHEN turn % 7 = 0 THEN 0 ELSE n END::BIGINT AS txn_count,
    CASE WHEN turn % 2 = 0 THEN own_account_id END AS own_account_id,
    CASE WHEN turn % 8 = 0 THEN 'user_assigned' WHEN turn % 2 = 0 THEN 'header_match' END AS account_source,
    'att_' || (seq % 900) AS attachment_id
  FROM (SELECT owner_id, document_id, own_account_id, count(*) AS n, min(seq) AS seq, min(institution_id) AS nation,
      substr(own_account_id, 5)::BIGINT AS account, account + min(year(txn_date)) AS turn
    FROM ledger_orders GROUP BY owner_id, document_id, own_account_id))"""


def sql_resolved(source: str, learn: bool) -> str:
    # the same policy told as correlated look-ups over earlier documents instead of keyed aggregates
    learned = "(SELECT arg_min(e.last4, (e.seq, e.document_id)) FROM fam e WHERE e.owner_id = d.owner_id AND e.kind = d.kind AND e.family = d.family AND e.last4 IS NOT NULL)"
    first = "(SELECT min((e.seq, e.document_id)) FROM fam e WHERE e.owner_id = d.owner_id AND e.kind = d.kind AND e.family = d.family AND e.last4 IS NOT NULL)"
    claims = f"n = 1 AND unnumbered = 1{f' AND last4 = {learned}' if learn else ''}"
    lone = f"CASE WHEN (seq, document_id) = {first} THEN 'institution_unique' ELSE 'header_match' END" if learn else "'institution_unique'"
    return f"""
regs AS (SELECT *, coalesce(regexp_replace(institution_id, '-cards$', ''), '') AS family FROM accounts),
fam AS (SELECT s.*, CASE WHEN doc_type = 'card_statement' THEN 'card' ELSE 'bank' END AS kind,
    coalesce(regexp_replace(institution_id, '-cards$', ''), '') AS family, account_last4 AS last4 FROM {source} s),
counted AS (SELECT d.*, coalesce(f.n, 0) AS n, coalesce(f.unnumbered, 0) AS unnumbered, f.sole, m.hit FROM fam d
  LEFT JOIN (SELECT owner_id, kind, family, count(*) AS n, count(*) FILTER (WHERE last4 IS NULL) AS unnumbered, min(account_id) AS sole FROM regs GROUP BY ALL) f USING (owner_id, kind, family)
  LEFT JOIN (SELECT owner_id, kind, family, last4, min(account_id) AS hit FROM regs WHERE last4 IS NOT NULL GROUP BY ALL) m USING (owner_id, kind, family, last4)),
choice AS (SELECT d.*, CASE WHEN last4 IS NOT NULL AND hit IS NOT NULL THEN 'number' WHEN last4 IS NOT NULL AND {claims} THEN 'lone' WHEN last4 IS NOT NULL THEN 'stub' ELSE 'none' END AS how,
   CASE WHEN last4 IS NOT NULL AND hit IS NULL AND {claims} THEN {lone} END AS lone_source FROM counted d),
stubs AS (SELECT owner_id, kind, family, last4, min((seq, document_id)) AS at FROM choice WHERE how = 'stub' GROUP BY ALL),
resolved AS (SELECT c.*, (SELECT count(*) FROM stubs s WHERE s.owner_id = c.owner_id AND s.kind = c.kind AND s.family = c.family AND s.at < (c.seq, c.document_id)) AS earlier,
   (SELECT s.at FROM stubs s WHERE s.owner_id = c.owner_id AND s.kind = c.kind AND s.family = c.family AND s.last4 = c.last4) AS mine FROM choice c),
answer AS (SELECT owner_id, document_id, CASE how WHEN 'number' THEN hit WHEN 'lone' THEN sole WHEN 'stub' THEN 'stub ' || kind || ' ' || family || ' ' || last4
    ELSE CASE WHEN institution_id IS NOT NULL AND txn_count > 0 AND n + earlier = 1 THEN CASE WHEN n = 1 THEN sole ELSE
      (SELECT min('stub ' || s.kind || ' ' || s.family || ' ' || s.last4) FROM stubs s WHERE s.owner_id = r.owner_id AND s.kind = r.kind AND s.family = r.family AND s.at < (r.seq, r.document_id)) END END END AS account,
    CASE how WHEN 'number' THEN 'header_match' WHEN 'lone' THEN lone_source WHEN 'stub' THEN CASE WHEN mine = (seq, document_id) THEN 'stub' ELSE 'header_match' END
    ELSE CASE WHEN institution_id IS NOT NULL AND txn_count > 0 AND n + earlier = 1 THEN 'institution_unique' END END AS account_source FROM resolved r)"""


def on_documents(select: str, *ctes: str) -> str:
    return b.with_ctes(b.SQL_ORDERS, b.SQL_ACCOUNTS, SQL_DOCUMENTS, *ctes, select=select)


def readable(resolved):
    """Shows a minted id by what it stands for, so both engines print the same text."""
    number = resolved.filter("account_source = 'stub'").select(
        "owner_id", "own_account_id",
        F.concat_ws(" ", F.lit("stub"), "own_account_kind", acc.issuer_family(F.col("institution_id")), "account_last4").alias("stub_name"),
    )
    return resolved.join(number, ["owner_id", "own_account_id"], "left").select(
        "owner_id", "document_id", F.coalesce("stub_name", "own_account_id").alias("account"), "account_source"
    )


@query(
    "account_stubs",
    on_documents(
        """SELECT owner_id, account_id, kind, last4, 1::BIGINT AS accounts FROM accounts
        UNION ALL SELECT owner_id, 'stub', kind, last4, count(*) FROM stubs GROUP BY owner_id, kind, last4""",
        sql_resolved("documents_view", False),
    ),
)
def account_stubs(spark, sf_dir):
    """The account table after a run: registered accounts, and a stub for each number nobody registered."""
    docs = documents(spark, sf_dir).drop("own_account_id", "own_account_kind", "account_source")
    known = b.accounts(spark, sf_dir)
    after = acc.with_stubs(known, acc.resolve_accounts(docs, known))
    minted = after.join(known.select("owner_id", "account_id", F.lit(True).alias("registered")), ["owner_id", "account_id"], "left")
    shown = minted.withColumn("account_id", F.when(F.col("registered"), F.col("account_id")).otherwise("stub"))
    return shown.groupBy("owner_id", "account_id", "kind", "last4").agg(F.count("*").alias("accounts"))


@query("resolve_account", on_documents("SELECT * FROM answer", sql_resolved("documents_view", False)))
def resolve_account(spark, sf_dir):
    docs = documents(spark, sf_dir).drop("own_account_id", "own_account_kind", "account_source")
    return readable(acc.resolve_accounts(docs, b.accounts(spark, sf_dir)))


SQL_PENDING = """
pending AS (SELECT d.* FROM documents_view d WHERE account_source IS DISTINCT FROM 'user_assigned'
  AND NOT EXISTS (SELECT 1 FROM accounts a WHERE a.owner_id = d.owner_id AND a.account_id = d.own_account_id))"""


@query("account_backfill", on_documents("SELECT * FROM answer", SQL_PENDING, sql_resolved("pending", True)))
def account_backfill(spark, sf_dir):
    return readable(acc.backfill_accounts(documents(spark, sf_dir), b.accounts(spark, sf_dir)))


@query(
    "account_backfill_stamp",
    on_documents(
        """SELECT txn_id, CASE WHEN p.document_id IS NULL THEN l.own_account_id ELSE a.account END AS account FROM ledger_orders l
        LEFT JOIN pending p USING (owner_id, document_id) LEFT JOIN answer a USING (owner_id, document_id)""",
        SQL_PENDING,
        sql_resolved("pending", True),
    ),
)
def account_backfill_stamp(spark, sf_dir):
    resolved = acc.backfill_accounts(documents(spark, sf_dir), b.accounts(spark, sf_dir))
    named = readable(resolved).select(
        "owner_id", "document_id", F.col("account").alias("own_account_id"), F.lit("bank").alias("own_account_kind")
    )
    return acc.stamp_transactions(b.ledger_orders(spark, sf_dir), named).select("txn_id", F.col("own_account_id").alias("account"))


@query(
    "reject_items",
    b.with_ctes(
        b.SQL_ORDERS, b.SQL_ACCOUNTS, SQL_DOCUMENTS, SQL_ATTACHMENTS, sql_resolved("documents_view", False),
        select="""SELECT document_id AS ref_id, CASE WHEN account IS NULL THEN 'account_unresolved' ELSE 'account_stub' END AS kind FROM answer
        WHERE account IS NULL OR account_source = 'stub'
        UNION ALL SELECT attachment_id, CASE WHEN status = 'review' THEN 'locked_pdf' ELSE 'unreadable' END FROM attachments WHERE status IN ('review', 'failed')""",
    ),
)
def reject_items(spark, sf_dir):
    """Review items for what ingest could not settle: files and documents."""
    docs = documents(spark, sf_dir).drop("own_account_id", "own_account_kind", "account_source")
    resolved = acc.resolve_accounts(docs, b.accounts(spark, sf_dir))
    unsettled = resolved.filter("needs_assignment or account_source = 'stub'").select(
        F.col("document_id").alias("ref_id"), F.when(F.col("needs_assignment"), "account_unresolved").otherwise("account_stub").alias("kind")
    )
    files = attachments(spark, sf_dir).filter("status in ('review', 'failed')").select(
        F.col("attachment_id").alias("ref_id"), F.when(F.col("status") == "review", "locked_pdf").otherwise("unreadable").alias("kind")
    )
    return unsettled.unionByName(files)


# --------------------------------------------------------------------------- assignments
SQL_CHOICES = """
choices AS (SELECT owner_id, document_id, 'acc_' || (substr(split_part(document_id, '_', 2), 1)::BIGINT + 1) AS account_id FROM documents_view WHERE seq % 3 = 0),
assigned AS (SELECT c.owner_id, c.document_id, c.account_id, a.kind FROM choices c JOIN accounts a USING (owner_id, account_id))"""


def choices(spark, sf_dir):
    customer = F.split("document_id", "_")[1].cast("bigint")
    return documents(spark, sf_dir).filter("seq % 3 = 0").select(
        "owner_id", "document_id", F.concat(F.lit("acc_"), customer + 1).alias("account_id")
    )


@query("assign_account", on_documents("SELECT owner_id, document_id, account_id AS own_account_id, kind AS own_account_kind, 'user_assigned' AS account_source FROM assigned", SQL_CHOICES))
def assign_account(spark, sf_dir):
    done = acc.assign_accounts(documents(spark, sf_dir), b.accounts(spark, sf_dir), choices(spark, sf_dir))
    return done.select("owner_id", "document_id", "own_account_id", "own_account_kind", "account_source")


@query(
    "assign_account_stamp",
    on_documents(
        """SELECT txn_id, coalesce(a.account_id, l.own_account_id) AS own_account_id, CASE WHEN a.account_id IS NULL THEN l.own_account_kind ELSE a.kind END AS own_account_kind
        FROM ledger_orders l LEFT JOIN assigned a USING (owner_id, document_id)""",
        SQL_CHOICES,
    ),
)
def assign_account_stamp(spark, sf_dir):
    done = acc.assign_accounts(documents(spark, sf_dir), b.accounts(spark, sf_dir), choices(spark, sf_dir))
    return acc.stamp_transactions(b.ledger_orders(spark, sf_dir), done).select("txn_id", "own_account_id", "own_account_kind")


@query(
    "resolve_review_items",
    on_documents(
        """SELECT item_id, CASE WHEN kind = 'account_unresolved' AND EXISTS (SELECT 1 FROM documents_view d
          WHERE 'doc_' || d.seq = r.ref_id AND d.owner_id % 50 = r.owner_id) THEN 'resolved' ELSE status END AS status FROM review_items r""",
        SQL_OPEN_ITEMS,
    ),
)
def resolve_review_items(spark, sf_dir):
    refs = documents(spark, sf_dir).select((F.col("owner_id") % 50).alias("owner_id"), F.concat(F.lit("doc_"), F.col("seq")).alias("ref_id"))
    return acc.resolve_items(review_items(spark, sf_dir), refs, ["account_unresolved"]).select("item_id", "status")


@query(
    "unassigned_docs",
    b.with_ctes(
        b.SQL_ORDERS, b.SQL_ACCOUNTS, SQL_DOCUMENTS, SQL_ATTACHMENTS,
        select="""SELECT d.owner_id, d.document_id, d.institution_id, d.doc_type, f.message_id AS file_name, s.n::BIGINT AS rows, s.first_date, s.last_date
        FROM documents_view d LEFT JOIN (SELECT owner_id, document_id, count(*) AS n, min(txn_date) AS first_date, max(txn_date) AS last_date FROM ledger_orders GROUP BY ALL) s USING (owner_id, document_id)
        LEFT JOIN attachments f ON f.attachment_id = d.attachment_id
        WHERE NOT EXISTS (SELECT 1 FROM accounts a WHERE a.owner_id = d.owner_id AND a.account_id = d.own_account_id)""",
    ),
)
def unassigned_docs(spark, sf_dir):
    files = attachments(spark, sf_dir).select("attachment_id", F.col("message_id").alias("file_name"))
    found = acc.unassigned_documents(b.ledger_orders(spark, sf_dir), documents(spark, sf_dir), b.accounts(spark, sf_dir), files)
    return found.drop("attachment_id")


@query("doc_attachment", b.with_ctes(b.SQL_ORDERS, SQL_DOCUMENTS, SQL_ATTACHMENTS, select="SELECT document_id, d.attachment_id, message_id, status FROM documents_view d LEFT JOIN attachments a ON a.attachment_id = d.attachment_id WHERE EXISTS (SELECT 1 FROM ledger_orders l WHERE l.document_id = d.document_id AND l.amount > 40000000)"))
def doc_attachment(spark, sf_dir):
    wanted = b.ledger_orders(spark, sf_dir).filter("amount > 40000000").select("document_id")
    files = attachments(spark, sf_dir).select("attachment_id", "message_id", "status")
    return documents(spark, sf_dir).join(wanted, "document_id", "left_semi").join(files, "attachment_id", "left").select(
        "document_id", "attachment_id", "message_id", "status"
    )


@query(
    "account_lookup",
    on_lines(
        """SELECT txn_id, own_account_id, nickname, last4, a.institution_id AS account_institution FROM ledger_lines l
        LEFT JOIN accounts a ON a.owner_id = l.owner_id AND a.account_id = l.own_account_id AND a.kind = l.own_account_kind""",
        b.SQL_ACCOUNTS,
    ),
)
def account_lookup(spark, sf_dir):
    a = b.accounts(spark, sf_dir).select(
        "owner_id", F.col("account_id").alias("own_account_id"), F.col("kind").alias("own_account_kind"), "nickname", "last4",
        F.col("institution_id").alias("account_institution"),
    )
    rows = b.ledger_lines(spark, sf_dir).select("owner_id", "txn_id", "own_account_id", "own_account_kind")
    return rows.join(a, ["owner_id", "own_account_id", "own_account_kind"], "left").select(
        "txn_id", "own_account_id", "nickname", "last4", "account_institution"
    )


@query(
    "orphan_accounts",
    on_lines(
        """SELECT owner_id, own_account_id, count(*)::BIGINT AS rows FROM ledger_lines l WHERE own_account_id IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM accounts a WHERE a.owner_id = l.owner_id AND a.account_id = l.own_account_id) GROUP BY ALL""",
        b.SQL_ACCOUNTS,
    ),
)
def orphan_accounts(spark, sf_dir):
    gone = quality.orphaned(b.ledger_lines(spark, sf_dir), b.accounts(spark, sf_dir))
    return gone.groupBy("owner_id", "own_account_id").agg(F.count("*").alias("rows"))


@query("all_accounts", b.with_ctes(b.SQL_ACCOUNTS, select="SELECT owner_id, account_id, kind, institution_id, last4, nickname FROM accounts"))
def all_accounts(spark, sf_dir):
    stored = b.accounts(spark, sf_dir)
    return acc.all_accounts(stored.filter("kind = 'bank'").drop("kind"), stored.filter("kind = 'card'").drop("kind"))


# ------------------------------------------------------------------- profile account sync
def sync_accounts_input(spark, sf_dir):
    """Stored and declared accounts, several per owner, kind and institution."""
    c = b.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    base = [
        F.floor(key / b.ACCOUNTS_PER_OWNER).cast("bigint").alias("owner_id"),
        F.when(key % 3 == 0, "card").otherwise("bank").alias("kind"),
        F.concat(F.lit("inst_"), F.col("c_nationkey") % 4).alias("institution_id"),
    ]
    stored = c.filter(key % 2 == 0).select(
        *base, F.concat(F.lit("acc_"), F.lpad(key.cast("string"), 8, "0")).alias("account_id"),
        F.when(key % 10 != 0, F.lpad((key % 14).cast("string"), 4, "0")).alias("last4"),
    )
    seeds = c.filter(key % 5 < 3).select(
        *base, key.alias("seed_no"), F.when(key % 11 > 2, F.lpad((key % 14).cast("string"), 4, "0")).alias("last4")
    )
    return stored, seeds


SQL_SYNC = f"""
keyed AS (SELECT c_custkey AS key, CAST(floor(c_custkey / {b.ACCOUNTS_PER_OWNER}) AS BIGINT) AS owner_id, CASE WHEN c_custkey % 3 = 0 THEN 'card' ELSE 'bank' END AS kind,
  'inst_' || (c_nationkey % 4) AS institution_id FROM customer),
stored AS (SELECT owner_id, kind, institution_id, 'acc_' || lpad(key::VARCHAR, 8, '0') AS account_id, CASE WHEN key % 10 <> 0 THEN lpad((key % 14)::VARCHAR, 4, '0') END AS last4,
  count(*) OVER (PARTITION BY owner_id, kind, institution_id) AS n FROM keyed WHERE key % 2 = 0),
seeds AS (SELECT owner_id, kind, institution_id, key AS seed_no, CASE WHEN key % 11 > 2 THEN lpad((key % 14)::VARCHAR, 4, '0') END AS last4,
  row_number() OVER (PARTITION BY owner_id, kind, institution_id ORDER BY key) AS k FROM keyed WHERE key % 5 < 3),
walk AS (
  SELECT DISTINCT owner_id, kind, institution_id, 0::BIGINT AS k, []::VARCHAR[] AS used, NULL::BIGINT AS seed_no, NULL::VARCHAR AS last4, NULL::VARCHAR AS account_id FROM seeds
  UNION ALL
  SELECT owner_id, kind, institution_id, k, CASE WHEN found IS NULL THEN used ELSE list_append(used, found) END, seed_no, coalesce(last4, found_last4), found FROM (
    SELECT *, coalesce(exact, CASE WHEN pool = 1 AND (only_last4 IS NULL OR last4 IS NULL) THEN sole END) AS found,
      CASE WHEN exact IS NULL AND pool = 1 AND last4 IS NULL THEN only_last4 END AS found_last4 FROM (
      SELECT w.owner_id, w.kind, w.institution_id, s.k, w.used, s.seed_no, s.last4,
        min(e.account_id) FILTER (WHERE e.last4 IS NOT DISTINCT FROM s.last4) AS exact, count(e.account_id) AS pool, min(e.account_id) AS sole, min(e.last4) AS only_last4
      FROM walk w JOIN seeds s ON s.owner_id = w.owner_id AND s.kind = w.kind AND s.institution_id = w.institution_id AND s.k = w.k + 1
      LEFT JOIN stored e ON e.owner_id = w.owner_id AND e.kind = w.kind AND e.institution_id = w.institution_id AND NOT list_contains(w.used, e.account_id)
      GROUP BY ALL))),
claims AS (SELECT owner_id, kind, institution_id, seed_no, last4, account_id FROM walk WHERE k > 0)"""


@query("natural_key_claim", b.with_ctes(SQL_SYNC, select="SELECT * FROM claims").replace("WITH ", "WITH RECURSIVE ", 1))
def natural_key_claim(spark, sf_dir):
    stored, seeds = sync_accounts_input(spark, sf_dir)
    return acc.claim_by_natural_key(seeds, stored)


@query(
    "profile_account_sync",
    b.with_ctes(
        SQL_SYNC,
        select="""SELECT owner_id, kind, institution_id, last4, CASE WHEN account_id IS NULL THEN 'new' ELSE 'claimed' END AS origin FROM claims
        UNION ALL SELECT owner_id, kind, institution_id, last4, 'referenced' FROM stored s
        WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.owner_id = s.owner_id AND c.account_id = s.account_id)
          AND EXISTS (SELECT 1 FROM orders o WHERE 'acc_' || lpad(o.o_custkey::VARCHAR, 8, '0') = s.account_id AND o.o_orderstatus = 'P' AND o.o_orderpriority = '5-LOW')""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def profile_account_sync(spark, sf_dir):
    stored, seeds = sync_accounts_input(spark, sf_dir)
    used = b.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' and o_orderpriority = '5-LOW'").select(
        F.floor(F.col("o_custkey") / b.ACCOUNTS_PER_OWNER).cast("bigint").alias("owner_id"),
        F.concat(F.lit("acc_"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("own_account_id"),
    )
    return acc.sync_accounts(seeds, stored, used).drop("account_id")


@query(
    "ref_check",
    "SELECT DISTINCT 'sup-' || (l_suppkey + l_linenumber * 30) AS institution_id FROM lineitem WHERE l_suppkey + l_linenumber * 30 NOT IN (SELECT s_suppkey FROM supplier)",
)
def ref_check(spark, sf_dir):
    used = b.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("sup-"), F.col("l_suppkey") + F.col("l_linenumber") * 30).alias("institution_id"))
    known = b.table(spark, sf_dir, "supplier").select(F.concat(F.lit("sup-"), F.col("s_suppkey")).alias("institution_id"))
    return acc.missing_references(used, known)


@query(
    "project_sync",
    on_lines(
        """SELECT owner_id, project_id, budget FROM seeds
        UNION ALL SELECT owner_id, project_id, budget FROM existing e WHERE (owner_id, project_id) NOT IN (SELECT owner_id, project_id FROM seeds)
          AND (owner_id, project_id) IN (SELECT owner_id, project_id FROM ledger_lines WHERE project_id IS NOT NULL)""",
        f"existing AS (SELECT DISTINCT CAST(floor(c_custkey / {b.ACCOUNTS_PER_OWNER}) AS BIGINT) AS owner_id, unnest(['proj_' || owner_id, 'idle_' || owner_id]) AS project_id, 100::BIGINT AS budget FROM customer)",
        "seeds AS (SELECT owner_id, project_id, 200::BIGINT AS budget FROM existing WHERE owner_id % 3 = 0)",
    ),
)
def project_sync(spark, sf_dir):
    owner = F.floor(F.col("c_custkey") / b.ACCOUNTS_PER_OWNER).cast("bigint")
    existing = b.table(spark, sf_dir, "customer").select(owner.alias("owner_id")).distinct().select(
        "owner_id",
        F.explode(F.array(F.concat(F.lit("proj_"), "owner_id"), F.concat(F.lit("idle_"), "owner_id"))).alias("project_id"),
        F.lit(100).cast("bigint").alias("budget"),
    )
    seeds = existing.filter("owner_id % 3 = 0").withColumn("budget", F.lit(200).cast("bigint"))
    return acc.sync_projects(existing, seeds, b.ledger_lines(spark, sf_dir))


# --------------------------------------------------------------------------- table updates
LEDGER = ["owner_id", "txn_id", "document_id", "amount", "category", "flow"]


def stored_and_new(spark, sf_dir):
    rows = b.ledger_lines(spark, sf_dir).select(*LEDGER)
    stored = rows.filter("amount % 4 <> 0")
    fresh = rows.filter("amount % 3 = 0").withColumns({"category": F.concat("category", F.lit(" new")), "amount": F.col("amount") + 1})
    return stored, fresh


@query(
    "ledger_upsert",
    on_lines(
        """SELECT owner_id, txn_id, document_id, CASE WHEN amount % 4 <> 0 THEN amount ELSE amount + 1 END AS amount,
        CASE WHEN amount % 3 = 0 THEN category || ' new' ELSE category END AS category, flow FROM ledger_lines WHERE amount % 4 <> 0 OR amount % 3 = 0"""
    ),
)
def ledger_upsert(spark, sf_dir):
    stored, fresh = stored_and_new(spark, sf_dir)
    return tables.upsert(stored, fresh, ["owner_id", "txn_id"], ["category", "flow"])


@query(
    "document_replace",
    on_lines(
        """SELECT txn_id, document_id, amount FROM ledger_lines WHERE NOT ends_with(document_id, '_1999')
        UNION ALL SELECT 'n' || txn_id, document_id, amount FROM ledger_lines WHERE ends_with(document_id, '_1999') AND amount % 2 = 0"""
    ),
)
def document_replace(spark, sf_dir):
    rows = b.ledger_lines(spark, sf_dir).select(*LEDGER)
    reparsed = rows.filter(F.col("document_id").endswith("_1999"))
    fresh = reparsed.filter("amount % 2 = 0").withColumn("txn_id", F.concat(F.lit("n"), "txn_id"))
    return tables.replace_documents(rows, fresh, reparsed).select("txn_id", "document_id", "amount")


SQL_CHILDREN = """
gone AS (SELECT owner_id, txn_id FROM ledger_lines WHERE amount % 3 = 0),
predictions AS (SELECT owner_id, 'pred_' || txn_id AS prediction_id, txn_id FROM ledger_lines WHERE amount % 2 = 0),
feedback AS (SELECT owner_id, 'fb_' || txn_id AS feedback_id, txn_id, category FROM ledger_lines WHERE amount % 5 = 0)"""


@query(
    "cascade_detach",
    on_lines(
        """SELECT 'prediction' AS kind, prediction_id AS id, txn_id FROM predictions WHERE txn_id NOT IN (SELECT txn_id FROM gone)
        UNION ALL SELECT 'feedback', feedback_id, CASE WHEN txn_id NOT IN (SELECT txn_id FROM gone) THEN txn_id END FROM feedback""",
        SQL_CHILDREN,
    ),
)
def cascade_detach(spark, sf_dir):
    rows = b.ledger_lines(spark, sf_dir).select(*LEDGER)
    gone = rows.filter("amount % 3 = 0")
    predictions = rows.filter("amount % 2 = 0").select("owner_id", F.concat(F.lit("pred_"), "txn_id").alias("id"), "txn_id")
    feedback = rows.filter("amount % 5 = 0").select("owner_id", F.concat(F.lit("fb_"), "txn_id").alias("id"), "txn_id")
    left = tables.drop_children(predictions, gone, ["txn_id"]).select(F.lit("prediction").alias("kind"), "id", "txn_id")
    return left.unionByName(tables.detach_children(feedback, gone).select(F.lit("feedback").alias("kind"), "id", "txn_id"))


def _stored_copy(spark, rows):
    """`rows` as a stored table of its own."""
    folder = f"{shared_folder(spark)}/table-{uuid4().hex}"
    partitions.write_new(rows, folder)
    return folder


@query(
    "stored_upsert",
    on_lines(
        """SELECT owner_id, txn_id, txn_date, CASE WHEN amount % 4 <> 0 THEN amount ELSE amount + 1 END AS amount,
        CASE WHEN txn_date >= DATE '1999-01-01' AND amount % 3 = 0 THEN category || ' new' ELSE category END AS category
        FROM ledger_lines WHERE amount % 4 <> 0 OR (txn_date >= DATE '1999-01-01' AND amount % 3 = 0)"""
    ),
)
def stored_upsert(spark, sf_dir):
    """An upsert of recent rows into a stored ledger, of which only the touched places are rewritten."""
    rows = b.ledger_lines(spark, sf_dir).select("owner_id", "txn_id", "txn_date", "amount", "category")
    folder = _stored_copy(spark, rows.filter("amount % 4 <> 0"))
    fresh = rows.filter("txn_date >= date'1999-01-01' and amount % 3 = 0")
    fresh = fresh.withColumns({"category": F.concat("category", F.lit(" new")), "amount": F.col("amount") + 1})
    partitions.upsert_stored(folder, fresh, ["owner_id", "txn_id"], ["category"])
    return partitions.read(spark, folder).drop(*partitions.PLACE)


@query(
    "stored_document_replace",
    on_lines(
        """SELECT txn_id, document_id, amount FROM ledger_lines WHERE NOT ends_with(document_id, '_1999')
        UNION ALL SELECT 'n' || txn_id, document_id, amount FROM ledger_lines WHERE ends_with(document_id, '_1999') AND amount % 2 = 0"""
    ),
)
def stored_document_replace(spark, sf_dir):
    """Documents of one year parsed again and replaced in a stored ledger."""
    rows = b.ledger_lines(spark, sf_dir).select(*LEDGER, "txn_date")
    folder = _stored_copy(spark, rows)
    # read from the table and written once, as the table itself changes
    again, _ = written(partitions.read(spark, folder).select(*LEDGER, "txn_date").filter(F.col("document_id").endswith("_1999")), "again")
    fresh = again.filter("amount % 2 = 0").withColumn("txn_id", F.concat(F.lit("n"), "txn_id"))
    partitions.replace_documents_stored(folder, fresh, again)
    return partitions.read(spark, folder).select("txn_id", "document_id", "amount")


@query("semi_ids", on_lines("SELECT txn_id FROM ledger_lines WHERE document_id IN (SELECT 'doc_' || c_custkey || '_1998' FROM customer WHERE c_acctbal > 5000)"))
def semi_ids(spark, sf_dir):
    ids = b.table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.concat(F.lit("doc_"), F.col("c_custkey"), F.lit("_1998")).alias("document_id"))
    return b.ledger_lines(spark, sf_dir).join(ids, "document_id", "left_semi").select("txn_id")


@query(
    "anti_existing",
    b.with_ctes(b.SQL_ORDERS, select="SELECT txn_id FROM ledger_orders WHERE document_id NOT IN (SELECT document_id FROM ledger_orders WHERE amount > 40000000)"),
)
def anti_existing(spark, sf_dir):
    rows = b.ledger_orders(spark, sf_dir)
    stored = rows.filter("amount > 40000000").select("document_id")
    return rows.join(stored, "document_id", "left_anti").select("txn_id")


@query(
    "requeue",
    b.with_ctes(
        SQL_ATTACHMENTS,
        select="SELECT attachment_id, CASE WHEN status IN ('review', 'failed') THEN 'pending' ELSE status END AS status FROM attachments",
    ),
)
def requeue(spark, sf_dir):
    return tables.requeue(attachments(spark, sf_dir), ["review", "failed"]).select("attachment_id", "status")


@query(
    "requeue_result",
    b.with_ctes(
        SQL_ATTACHMENTS,
        select="""SELECT number % 50 AS owner_id, count(*) AS locked_before, count(*) FILTER (WHERE number % 3 = 0) AS still_locked,
        count(*) FILTER (WHERE number % 3 <> 0) AS unlocked
        FROM (SELECT split_part(attachment_id, '_', 2)::BIGINT AS number FROM attachments WHERE status = 'review') GROUP BY 1""",
    ),
)
def requeue_result(spark, sf_dir):
    """Locked files before a retry with a new password, and after it, when a third of them stays locked."""
    number = F.split_part("attachment_id", F.lit("_"), F.lit(2)).cast("bigint")
    locked = attachments(spark, sf_dir).filter("status = 'review'").select(
        (number % 50).alias("owner_id"), number.alias("number"), F.lit("locked_pdf").alias("kind")
    )
    return tables.requeue_result(locked, locked.filter("number % 3 = 0"))


@query(
    "ledger_health",
    on_lines(
        f"""SELECT owner_id, metric, '' AS key, value::BIGINT AS value FROM (
          UNPIVOT (SELECT l.owner_id, count(*) AS transactions, count(*) FILTER (WHERE l.own_account_id IS NOT NULL AND a.account_id IS NOT NULL) AS attributed,
            count(*) FILTER (WHERE l.own_account_id IS NULL) AS missing_account, count(*) FILTER (WHERE l.own_account_id IS NOT NULL AND a.account_id IS NULL) AS orphaned_account,
            count(*) FILTER (WHERE lower(category) = 'uncategorised') AS uncategorised, count(*) FILTER (WHERE review_required) AS in_review,
            count(*) FILTER (WHERE suspected_transfer) AS suspected_transfers, count(*) FILTER (WHERE is_internal_transfer) AS internal_transfers
            FROM ledger_lines l LEFT JOIN accounts a ON a.owner_id = l.owner_id AND a.account_id = l.own_account_id GROUP BY 1)
          ON COLUMNS(* EXCLUDE owner_id) INTO NAME metric VALUE value)
        UNION ALL SELECT owner_id, 'duplicate_groups', '', count(*)::BIGINT FROM dups GROUP BY 1
        UNION ALL SELECT owner_id, 'duplicate_excess', '', sum(n - 1)::BIGINT FROM dups GROUP BY 1
        UNION ALL SELECT owner_id, 'confidence', confidence, count(*)::BIGINT FROM ledger_lines GROUP BY 1, 3
        UNION ALL SELECT owner_id, 'source', source, count(*)::BIGINT FROM ledger_lines GROUP BY 1, 3
        UNION ALL SELECT owner_id, 'layer', layer::VARCHAR, count(*)::BIGINT FROM ledger_lines GROUP BY 1, 3
        UNION ALL SELECT owner_id, 'period', fy_key, count(*)::BIGINT FROM ledger_lines GROUP BY 1, 3""",
        b.SQL_ACCOUNTS,
        f"dups AS (SELECT owner_id, count(*) AS n FROM ledger_lines GROUP BY owner_id, year(txn_date), sign(amount), {b.sql_signature('reason')}, own_account_id HAVING count(*) > 1)",
    ),
)
def ledger_health(spark, sf_dir):
    # coarse dates, amounts and texts, so that the key really repeats
    coarse = {
        "txn_date": F.trunc("txn_date", "year"), "amount": F.signum("amount").cast("bigint"), "raw_description": F.col("reason"),
    }
    return quality.ledger_health(b.ledger_lines(spark, sf_dir).withColumns(coarse), b.accounts(spark, sf_dir))
