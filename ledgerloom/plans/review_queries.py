"""Review queue, assignment, journal and question-routing queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import text
from ledgerloom.operators import accounts as acc
from ledgerloom.operators import dedup, labels, recurrence, review, rollups, routing, tables
from ledgerloom.plans import bindings as b
from ledgerloom.plans.integrity_queries import SQL_CANDIDATES, SQL_CHARGES, SQL_SUBSCRIPTIONS, charges, on_statements, sql_pairs, statement_rows
from ledgerloom.plans.registry import query
from ledgerloom.plans.rollup_queries import SQL_OPEN_ITEMS, on_lines, review_items
from ledgerloom.plans.rule_queries import sql_normalized
from ledgerloom.session import checkpointed, stored

# --------------------------------------------------------------------------------- items


def stored_items(spark, sf_dir):
    return review_items(spark, sf_dir).select(
        "item_id", "owner_id", "kind", "ref_id", F.lit("old").alias("title"), F.lit("").alias("detail"), F.lit("warn").alias("severity"), "status"
    )


@query(
    "review_items_rebuild",
    on_lines(
        f"""SELECT item_id, owner_id, kind, ref_id, 'old' AS title, '' AS detail, 'warn' AS severity, status FROM review_items WHERE kind NOT IN ('uncategorised', 'low_confidence')
        UNION ALL SELECT {b.sql_capped("'rev_txn_' || txn_id", 80)}, owner_id, CASE WHEN lower(category) = 'uncategorised' THEN 'uncategorised' ELSE 'low_confidence' END, txn_id,
          'Please check: ' || substr(raw_description, 1, 48), reason, 'info', 'open' FROM ledger_lines WHERE review_required""",
        SQL_OPEN_ITEMS,
    ),
)
def review_items_rebuild(spark, sf_dir):
    return review.rebuild_items(stored_items(spark, sf_dir), b.ledger_lines(spark, sf_dir))


# -------------------------------------------------------------------------------- groups
def suggestions(spark, sf_dir):
    """A stored suggestion, with its JSON provenance, for a part of the pending rows."""
    rows = b.ledger_lines(spark, sf_dir).filter("review_required and amount % 3 = 0")
    score = (F.abs("amount") % 5).cast("double") / 10
    blob = F.when(F.col("amount") % 2 == 0, F.concat(
        F.lit('{"distribution":[{"category":"gift","probability":0.2},{"category":"cabs","probability":'), score.cast("string"),
        F.lit('},{"category":"nonsense","probability":0.9},{"category":"fuel","probability":0.25},{"category":"salary"}]}'),
    )).otherwise(F.lit("{broken"))
    return rows.select(
        "owner_id", "txn_id",
        F.struct(
            score.alias("score"), F.when(F.col("amount") % 5 == 1, "expenses.health.pharmacy").otherwise("Dining").alias("category"),
            review.parse_distribution(blob).alias("distribution"), F.concat(F.lit("sug_"), "txn_id").alias("suggestion_id"),
        ).alias("suggestion"),
    )


SQL_GROUPS = f"""
pending AS (SELECT *, {b.sql_signature('raw_description')} AS signature FROM ledger_lines WHERE review_required),
groups AS (SELECT owner_id, signature, count(*)::BIGINT AS rows, sum(abs(amount))::BIGINT AS minor, min(txn_date) AS first_date, max(txn_date) AS last_date, bool_or(suspected_transfer) AS suspected_transfer,
    arg_min(raw_description, (txn_date, txn_id)) AS described, arg_min(flow, (txn_date, txn_id)) AS flow, arg_min(category, (txn_date, txn_id)) AS category,
    arg_min([own_account_id], (txn_date, txn_id))[1] AS own_account_id, arg_min([own_account_kind], (txn_date, txn_id))[1] AS own_account_kind,
    arg_min(txn_id, (-(abs(amount) % 5), txn_id)) FILTER (WHERE amount % 3 = 0) AS best_txn, arg_min(amount, (-(abs(amount) % 5), txn_id)) FILTER (WHERE amount % 3 = 0) AS best_amount
  FROM pending WHERE signature <> '' GROUP BY ALL),
placed AS (SELECT *, (row_number() OVER (PARTITION BY owner_id ORDER BY minor DESC, rows DESC, signature))::INT AS position, {b.sql_major('minor')} AS total FROM groups)"""
GROUP = ["owner_id", "signature", "rows", "total", "first_date", "last_date", "suspected_transfer", "flow", "position"]


@query(
    "review_groups",
    on_lines(
        f"""SELECT {', '.join(GROUP)}, substr(trim(described), 1, 80) AS sample, nullif(category, 'Uncategorised') AS category, 'sug_' || best_txn AS suggestion_id,
        substr(array_to_string(list_transform(string_split(signature, ' '), lambda w: upper(w[1]) || w[2:]), ' '), 1, 40) AS suggested_merchant FROM placed WHERE position <= 150""",
        SQL_GROUPS,
    ),
)
def review_groups(spark, sf_dir):
    groups = review.top_groups(review.review_groups(b.ledger_lines(spark, sf_dir), suggestions(spark, sf_dir)))
    return groups.select(*GROUP, "sample", "category", F.col("suggestion.suggestion_id").alias("suggestion_id"), "suggested_merchant")


@query(
    "review_filter",
    on_lines("SELECT owner_id, signature, count(*)::BIGINT AS rows FROM pending WHERE signature <> '' AND contains(lower(raw_description), 'blue r') GROUP BY ALL", SQL_GROUPS),
)
def review_filter(spark, sf_dir):
    groups = review.review_groups(b.ledger_lines(spark, sf_dir), suggestions(spark, sf_dir), contains=" Blue R")
    return groups.select("owner_id", "signature", "rows")


def sql_pool() -> str:
    arms = " ".join(f"WHEN '{flow}' THEN {cats!r}" for flow, cats in fv.TAXONOMY.items())
    return f"CASE flow {arms} END"


FREQUENT = """
frequency AS (SELECT owner_id, list(category ORDER BY n DESC, category)[1:8] AS frequent FROM (
  SELECT owner_id, lower(category) AS category, count(*) AS n FROM ledger_lines WHERE NOT review_required AND lower(category) <> 'uncategorised' GROUP BY ALL) GROUP BY 1),
pooled AS (SELECT p.*, f.frequent, CASE WHEN best_txn IS NULL THEN NULL WHEN best_amount % 5 = 1 THEN 'pharmacy' ELSE 'dining' END AS suggested,
    CASE WHEN best_txn IS NOT NULL AND best_amount % 2 = 0 THEN abs(best_amount) % 5 / 10.0 END AS cabs FROM placed p LEFT JOIN frequency f USING (owner_id)),
ranked AS (SELECT *, """ + sql_pool() + """ AS pool FROM pooled),
offered AS (SELECT owner_id, signature, position, option, min(place) AS place FROM (
    SELECT owner_id, signature, position, pool, unnest(list_concat([suggested], CASE WHEN cabs IS NULL THEN [] WHEN cabs > 0.25 THEN ['cabs', 'fuel', 'gift'] WHEN cabs > 0.2 THEN ['fuel', 'cabs', 'gift'] ELSE ['fuel', 'gift', 'cabs'] END, coalesce(frequent, []), pool)) AS option,
      unnest(range(1, 1 + len(list_concat([suggested], CASE WHEN cabs IS NULL THEN [] ELSE ['a', 'b', 'c'] END, coalesce(frequent, []), pool)))) AS place FROM ranked)
  WHERE list_contains(pool, option) GROUP BY ALL)"""


@query(
    "rank_shortlist",
    on_lines("SELECT owner_id, signature, string_agg(option, ',' ORDER BY place) AS ranked FROM (SELECT * FROM offered WHERE position <= 150 QUALIFY row_number() OVER (PARTITION BY owner_id, signature ORDER BY place) <= 5) GROUP BY ALL", SQL_GROUPS, FREQUENT),
)
def rank_shortlist(spark, sf_dir):
    return full_queue(spark, sf_dir).select("owner_id", "signature", F.array_join("ranked", ",").alias("ranked"))


def full_queue(spark, sf_dir):
    ledger = b.ledger_lines(spark, sf_dir)
    return review.review_queue(ledger, suggestions(spark, sf_dir), b.accounts(spark, sf_dir), rollups.category_frequency(ledger))


@query(
    "review_queue",
    on_lines(
        f"""SELECT p.owner_id, signature, rows, total, position, nickname AS account_nickname, last4 AS account_last4, a.institution_id AS account_institution
        FROM placed p LEFT JOIN accounts a ON a.owner_id = p.owner_id AND a.account_id = p.own_account_id AND a.kind = p.own_account_kind WHERE position <= 150""",
        SQL_GROUPS,
        b.SQL_ACCOUNTS,
    ),
)
def review_queue(spark, sf_dir):
    return full_queue(spark, sf_dir).select(
        "owner_id", "signature", "rows", "total", "position", "account_nickname", "account_last4", "account_institution"
    )


SAMPLE = "blue rod store supplier"


@query(
    "group_drilldown",
    on_lines(
        f"""SELECT owner_id, txn_id, txn_date, {b.sql_major('amount')} AS amount, raw_description, reason, from_addr, subject
        FROM pending LEFT JOIN messages USING (message_id) WHERE signature = '{SAMPLE}' QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY txn_date DESC, txn_id) <= 100""",
        SQL_GROUPS,
        b.SQL_MESSAGES,
    ),
)
def group_drilldown(spark, sf_dir):
    rows = b.ledger_lines(spark, sf_dir).filter("review_required").filter(text.signature(F.col("raw_description")) == SAMPLE)
    shown = rollups.display_rows(rollups.latest(rows, ["owner_id"], 100), b.messages(spark, sf_dir))
    described = rows.select("owner_id", "txn_id", "raw_description")
    return shown.join(described, ["owner_id", "txn_id"]).select(
        "owner_id", "txn_id", "txn_date", "amount", "raw_description", "reason", "from_addr", "subject"
    )


SQL_PAIR_STATUS = """
open_pairs AS (SELECT p.* FROM pairs p JOIN keyed c ON c.owner_id = p.owner_id AND c.txn_id = p.candidate_txn_id WHERE c.seq % 4 NOT IN (0, 1)),
sides AS (SELECT d.duplicate_id, k.document_id AS keeper_document_id, c.document_id AS candidate_document_id, CAST(floor((c.amount + 50) / 100.0) AS BIGINT) AS amount,
    mk.subject AS keeper_subject, k.raw_description AS keeper_text, c.raw_description AS candidate_text
  FROM open_pairs d JOIN keyed k ON k.owner_id = d.owner_id AND k.txn_id = d.keeper_txn_id JOIN keyed c ON c.owner_id = d.owner_id AND c.txn_id = d.candidate_txn_id
  LEFT JOIN messages mk ON mk.message_id = 'm' || (k.seq % 300))"""
PAIR = ["duplicate_id", "keeper_document_id", "candidate_document_id", "amount", "keeper_subject"]


def open_pairs(spark, sf_dir, contains=None):
    """The suspected pairs of all statement rows, after a user settled half of them."""
    rows = statement_rows(spark, sf_dir)
    pairs = dedup.suspected_pairs(rows.limit(0), rows).withColumn("status", F.lit("open"))
    four = F.col("seq") % 4
    choices = rows.filter(four <= 1).select(
        F.concat(F.lit("dup_"), F.col("txn_id")).alias("duplicate_id"), F.when(four == 0, "kept").otherwise("removed").alias("choice")
    )
    ledger = rows.withColumn("message_id", F.concat(F.lit("m"), F.col("seq") % 300))
    return review.expand_duplicates(dedup.decide(pairs, choices), ledger, b.messages(spark, sf_dir), contains).select(*PAIR)


@query("dup_pair_expand", on_statements(f"SELECT {', '.join(PAIR)} FROM sides", sql_pairs("false", "true"), b.SQL_MESSAGES, SQL_PAIR_STATUS))
def dup_pair_expand(spark, sf_dir):
    return open_pairs(spark, sf_dir)


@query(
    "dup_pair_search",
    on_statements(
        f"SELECT {', '.join(PAIR)} FROM sides WHERE contains(lower(keeper_text), 'building') OR contains(lower(candidate_text), 'building')",
        sql_pairs("false", "true"), b.SQL_MESSAGES, SQL_PAIR_STATUS,
    ),
)
def dup_pair_search(spark, sf_dir):
    return open_pairs(spark, sf_dir, contains=" Building")


# --------------------------------------------------------------------------- assignments
def assignments(spark, sf_dir, ledger=None):
    """User choices for some pending signatures of every owner."""
    rows = (b.ledger_lines(spark, sf_dir) if ledger is None else ledger).filter("review_required")
    groups = rows.groupBy("owner_id", text.signature(F.col("raw_description")).alias("signature")).agg(F.count("*").alias("n"), F.min("txn_id").alias("first"))
    number = F.substring(F.regexp_extract("first", "^t([0-9]+)_", 1), -2, 2).cast("int")
    words = F.split("signature", " ")
    return groups.filter(number % 3 == 0).select(
        "owner_id", number.cast("bigint").alias("seq"), "signature",
        F.when(number % 2 == 0, F.concat(words[1], F.lit(" Private "), words[0])).when(number % 5 == 0, "Elsewhere").otherwise("").alias("merchant"),
        F.when(number % 4 == 0, "Groceries").when(number % 4 == 1, "Credit Card Payment").when(number % 4 == 2, "travel").otherwise("Investment").alias("category"),
        F.when(number % 6 == 0, " monthly ").alias("subcategory"),
    )


SQL_ASSIGN = f"""
raw_groups AS (SELECT owner_id, signature, min(txn_id) AS first FROM pending GROUP BY ALL),
assignments AS (SELECT *, CASE WHEN seq % 4 = 0 THEN 'Groceries' WHEN seq % 4 = 1 THEN 'Transfer' WHEN seq % 4 = 2 THEN 'travel' ELSE 'Investment' END AS new_category,
    CASE WHEN seq % 4 = 0 THEN 'groceries' WHEN seq % 4 = 1 THEN 'cc_payment' WHEN seq % 4 = 2 THEN 'travel' ELSE 'investment' END AS canonical,
    CASE WHEN seq % 4 = 1 THEN 'Credit card payment' WHEN seq % 6 = 0 THEN 'monthly' END AS new_subcategory,
    CASE WHEN seq % 2 = 0 THEN split_part(signature, ' ', 2) || ' Private ' || split_part(signature, ' ', 1) WHEN seq % 5 = 0 THEN 'Elsewhere' ELSE '' END AS merchant
  FROM (SELECT owner_id, signature, right(regexp_extract(first, '^t([0-9]+)_', 1), 2)::BIGINT AS seq FROM raw_groups) WHERE seq % 3 = 0),
matched AS (SELECT p.owner_id, p.txn_id, p.amount, p.raw_description, p.signature, a.* EXCLUDE (owner_id, signature) FROM pending p JOIN assignments a USING (owner_id, signature)),
words AS (SELECT DISTINCT owner_id, signature, seq, w, list_position(list_filter(string_split_regex(lower(merchant), '[^a-z0-9]+'), lambda x: true), w) AS no
  FROM (SELECT *, unnest(string_split_regex(lower(merchant), '[^a-z0-9]+')) AS w FROM assignments WHERE new_category <> 'Transfer') WHERE length(w) >= 4 AND w NOT IN ({', '.join(repr(w) for w in fv.ALIAS_TOKEN_STOPWORDS)})),
tokens AS (SELECT owner_id, signature, seq, arg_min(w, (-length(w), no)) AS alias_token FROM words
  WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.owner_id = words.owner_id AND m.signature = words.signature AND NOT contains(lower(m.raw_description), words.w)) GROUP BY ALL),
swept AS (SELECT p.owner_id, p.txn_id, p.amount, p.raw_description, p.signature, arg_min({{s: a.seq, m: a.merchant, c: a.new_category, u: a.new_subcategory, k: a.canonical, t: t.alias_token}}, (a.seq, a.merchant, a.new_category, coalesce(a.new_subcategory, ''), a.canonical, t.alias_token)) AS r
  FROM pending p JOIN tokens t USING (owner_id) JOIN assignments a ON a.owner_id = t.owner_id AND a.signature = t.signature AND a.seq = t.seq
  WHERE contains(lower(p.raw_description), t.alias_token) AND (p.owner_id, p.signature) NOT IN (SELECT owner_id, signature FROM assignments) GROUP BY ALL),
changes AS (SELECT *, CASE WHEN canonical = 'cc_payment' THEN 'transfer' WHEN canonical = 'investment' THEN 'investment' ELSE 'expense' END AS new_flow FROM (
  SELECT owner_id, txn_id, amount, signature, seq, merchant, new_category, canonical, new_subcategory, t.alias_token, 1 AS layer FROM matched LEFT JOIN tokens t USING (owner_id, signature, seq)
  UNION ALL SELECT owner_id, txn_id, amount, signature, r.s, r.m, r.c, r.k, r.u, r.t, 4 FROM swept))"""


def changes(spark, sf_dir, ledger=None):
    rows = b.ledger_lines(spark, sf_dir) if ledger is None else ledger
    return review.assign_batch(rows, assignments(spark, sf_dir, ledger))


@query("derive_alias_token", on_lines("SELECT DISTINCT owner_id, signature, alias_token FROM changes WHERE layer = 1", SQL_GROUPS, SQL_ASSIGN))
def derive_alias_token(spark, sf_dir):
    return changes(spark, sf_dir).filter("layer = 1").select("owner_id", "signature", "alias_token").distinct()


@query(
    "assign_batch",
    on_lines(
        """SELECT l.txn_id, CASE WHEN c.txn_id IS NULL THEN l.merchant ELSE nullif(c.merchant, '') END AS merchant, coalesce(c.canonical, l.category) AS category,
        CASE WHEN c.txn_id IS NULL THEN l.subcategory ELSE c.new_subcategory END AS subcategory, coalesce(c.new_flow, l.flow) AS flow, coalesce(c.layer, l.layer)::INT AS layer,
        l.review_required AND c.txn_id IS NULL AS review_required, CASE WHEN c.txn_id IS NULL THEN l.is_internal_transfer ELSE c.new_flow = 'transfer' END AS is_internal_transfer
        FROM ledger_lines l LEFT JOIN changes c USING (owner_id, txn_id)""",
        SQL_GROUPS,
        SQL_ASSIGN,
    ),
)
def assign_batch(spark, sf_dir):
    done = review.apply_assignments(b.ledger_lines(spark, sf_dir), changes(spark, sf_dir))
    return done.select("txn_id", "merchant", "category", "subcategory", "flow", "layer", "review_required", "is_internal_transfer")


@query(
    "assign_overrides",
    on_lines(
        "SELECT DISTINCT owner_id, signature AS match_signature, nullif(merchant, '') AS merchant, canonical AS category, new_subcategory AS subcategory, CASE WHEN new_flow = 'transfer' THEN 'transfer' END AS flow FROM changes WHERE layer = 1",
        SQL_GROUPS,
        SQL_ASSIGN,
    ),
)
def assign_overrides(spark, sf_dir):
    return review.assigned_overrides(changes(spark, sf_dir))


@query(
    "assign_aliases",
    on_lines(
        """SELECT owner_id, 'ua_' || alias_token AS alias_id, arg_max(canonical, (seq, merchant, canonical, coalesce(new_subcategory, ''))) AS category FROM changes WHERE alias_token IS NOT NULL GROUP BY ALL""",
        SQL_GROUPS,
        SQL_ASSIGN,
    ),
)
def assign_aliases(spark, sf_dir):
    return review.assigned_aliases(changes(spark, sf_dir)).select("owner_id", "alias_id", "category")


@query(
    "assign_feedback",
    on_lines(
        f"""SELECT {b.sql_capped("'ex_review_assignment_' || c.txn_id", 120)} AS example_id, c.merchant, c.new_category AS category, c.new_subcategory AS subcategory,
        c.new_flow AS flow, l.institution_id, CASE WHEN c.amount >= 0 THEN 'credit' ELSE 'debit' END AS direction
        FROM changes c JOIN ledger_lines l USING (owner_id, txn_id) WHERE c.layer = 1""",
        SQL_GROUPS,
        SQL_ASSIGN,
    ),
)
def assign_feedback(spark, sf_dir):
    told = labels.example_rows(review.assignment_feedback(b.ledger_lines(spark, sf_dir), changes(spark, sf_dir)))
    return told.select("example_id", "merchant", "category", "subcategory", "flow", "institution_id", "direction")


@query(
    "assign_items",
    on_lines(
        f"""SELECT item_id, status FROM review_items WHERE kind NOT IN ('uncategorised', 'low_confidence')
        UNION ALL SELECT {b.sql_capped("'rev_txn_' || l.txn_id", 80)}, CASE WHEN c.txn_id IS NULL THEN 'open' ELSE 'resolved' END
        FROM ledger_lines l LEFT JOIN changes c USING (owner_id, txn_id) WHERE l.review_required""",
        SQL_OPEN_ITEMS,
        SQL_GROUPS,
        SQL_ASSIGN,
    ),
)
def assign_items(spark, sf_dir):
    items = review.rebuild_items(stored_items(spark, sf_dir), b.ledger_lines(spark, sf_dir))
    return review.resolve_items(items, changes(spark, sf_dir)).select("item_id", "status")


# ------------------------------------------------------------------------ journal, undo
JOURNALED = ["owner_id", "txn_id", "merchant", "category", "subcategory", "flow", "layer", "review_required", "is_internal_transfer"]


def journal_images(spark, sf_dir):
    ledger = b.ledger_lines(spark, sf_dir).select(*JOURNALED)
    touched = changes(spark, sf_dir)
    txns = review.before_image(ledger, touched, ["owner_id", "txn_id"], "transactions", F.lit("op1"))
    rules = existing_overrides(spark, sf_dir)
    direct = review.assigned_overrides(touched)
    return txns.unionByName(review.before_image(rules, direct, ["owner_id", "match_signature"], "overrides", F.lit("op1")))


def existing_overrides(spark, sf_dir, ledger=None):
    """Rules some owners already had for signatures that are assigned again."""
    return assignments(spark, sf_dir, ledger).filter("owner_id % 2 = 0").select(
        "owner_id", F.col("signature").alias("match_signature"), F.lit("Before").alias("merchant"), F.lit("gift").alias("category")
    )


@query(
    "before_image",
    on_lines(
        """SELECT 'transactions' AS table_name, true AS existed, count(*)::BIGINT AS rows FROM changes
        UNION ALL SELECT 'overrides', owner_id % 2 = 0, count(*)::BIGINT FROM (SELECT DISTINCT owner_id, signature FROM changes WHERE layer = 1) GROUP BY 2""",
        SQL_GROUPS,
        SQL_ASSIGN,
    ),
)
def before_image(spark, sf_dir):
    return journal_images(spark, sf_dir).groupBy("table_name", "existed").agg(F.count("*").alias("rows"))


@query("undo_restore", on_lines(f"SELECT {', '.join(c + ('::INT AS layer' if c == 'layer' else '') for c in JOURNALED)} FROM ledger_lines"))
def undo_restore(spark, sf_dir):
    """Assign, then restore from the before-images: the ledger is what it was."""
    # written once: choosing, assigning and restoring all read them
    ledger, _ = stored(b.ledger_lines(spark, sf_dir).select(*JOURNALED, "amount", "raw_description"), "ledger")
    touched, _ = stored(changes(spark, sf_dir, ledger), "changes")
    images, _ = stored(review.before_image(ledger.select(*JOURNALED), touched, ["owner_id", "txn_id"], "transactions", F.lit("op1")), "images")
    changed = review.apply_assignments(ledger, touched).select(*JOURNALED)
    return review.restore(changed, images, ["owner_id", "txn_id"], "transactions")


@query(
    "undo_overrides",
    on_lines("SELECT owner_id, signature AS match_signature, 'Before' AS merchant, 'gift' AS category FROM assignments WHERE owner_id % 2 = 0", SQL_GROUPS, SQL_ASSIGN),
)
def undo_overrides(spark, sf_dir):
    kept = existing_overrides(spark, sf_dir)
    fresh = review.assigned_overrides(changes(spark, sf_dir)).select(*kept.columns)
    images = review.before_image(kept, fresh, ["owner_id", "match_signature"], "overrides", F.lit("op1"))
    changed = tables.upsert(kept, fresh, ["owner_id", "match_signature"], ["merchant", "category"])
    return review.restore(changed, images, ["owner_id", "match_signature"], "overrides")


def review_state(spark, sf_dir):
    """Every table an assignment touches, some of whose rows it will meet again."""
    # written once: an assignment and its undo read every table several times
    ledger, _ = stored(b.ledger_lines(spark, sf_dir), "ledger")
    touched, _ = stored(changes(spark, sf_dir, ledger), "changes")
    overrides, _ = stored(existing_overrides(spark, sf_dir, ledger), "overrides")
    even = F.col("owner_id") % 2 == 0
    feedback = review.assignment_feedback(ledger, touched.filter(F.col("amount") % 2 == 0)).withColumn("merchant", F.lit("Before"))
    feedback, _ = stored(feedback, "feedback")
    return {
        "transactions": ledger, "overrides": overrides,
        "aliases": review.assigned_aliases(touched).filter(even).withColumn("category", F.lit("gift")),
        "feedback": labels.feedback_rows(feedback), "examples": labels.example_rows(feedback),
        "review_items": review.rebuild_items(stored_items(spark, sf_dir), ledger),
        "heads": touched.select("owner_id").distinct().withColumn("stale", F.lit(False)),
        "images": spark.createDataFrame([], "owner_id bigint, operation_id string, table_name string, row_key string, existed boolean, prior string"),
        "journal": spark.createDataFrame([], "owner_id bigint, operation_id string, created_at timestamp, consumed_at timestamp"),
    }


def state_rows(state):
    """All journalled tables, the heads and the journal as (table_name, row_key, value)."""
    shown = {
        "transactions": ("txn_id", ["merchant", "category", "flow", "review_required"]), "overrides": ("match_signature", ["merchant", "category"]),
        "aliases": ("alias_id", ["category"]), "feedback": ("feedback_id", ["merchant"]), "examples": ("example_id", ["merchant"]),
        "heads": (F.lit("head"), ["stale"]), "journal": ("operation_id", [F.col("consumed_at").isNotNull()]),
    }
    found = [
        state[name].select(
            F.lit(name).alias("table_name"), F.concat_ws("|", "owner_id", key).alias("row_key"),
            F.concat_ws("|", *[F.coalesce(F.col(v).cast("string") if isinstance(v, str) else v.cast("string"), F.lit("-")) for v in values]).alias("value"),
        )
        for name, (key, values) in shown.items()
    ]
    return reduce(DataFrame.unionByName, found)


@query(
    "undo_operation",
    on_lines(
        f"""SELECT 'transactions' AS table_name, owner_id || '|' || txn_id AS row_key, coalesce(merchant, '-') || '|' || coalesce(category, '-') || '|' || coalesce(flow, '-') || '|' || coalesce(review_required::VARCHAR, '-') AS value FROM ledger_lines
        UNION ALL SELECT 'overrides', owner_id || '|' || signature, 'Before|gift' FROM assignments WHERE owner_id % 2 = 0
        UNION ALL SELECT DISTINCT 'aliases', owner_id || '|ua_' || alias_token, 'gift' FROM changes WHERE alias_token IS NOT NULL AND owner_id % 2 = 0
        UNION ALL SELECT 'feedback', owner_id || '|' || {b.sql_capped("'fb_review_assignment_' || txn_id", 120)}, 'Before' FROM changes WHERE layer = 1 AND amount % 2 = 0
        UNION ALL SELECT 'examples', owner_id || '|' || {b.sql_capped("'ex_review_assignment_' || txn_id", 120)}, 'Before' FROM changes WHERE layer = 1 AND amount % 2 = 0
        UNION ALL SELECT DISTINCT 'heads', owner_id || '|head', 'true' FROM changes
        UNION ALL SELECT DISTINCT 'journal', owner_id || '|op1', 'true' FROM changes""",
        SQL_GROUPS,
        SQL_ASSIGN,
    ),
)
def undo_operation(spark, sf_dir):
    """A batch of assignments and its undo: all five tables are what they were, the heads stale, the operation consumed."""
    at = F.lit("2024-01-01").cast("timestamp")
    state = review_state(spark, sf_dir)
    chosen, _ = stored(assignments(spark, sf_dir, state["transactions"]), "assignments")
    assigned = review.assign(state, chosen, F.lit("op1"), at)
    return state_rows(review.undo(assigned, at))


def journal(spark, sf_dir):
    return b.table(spark, sf_dir, "events").select(
        F.floor(F.col("user_id") / 10).cast("bigint").alias("owner_id"), F.concat(F.lit("undo_"), F.col("event_id")).alias("operation_id"),
        F.date_trunc("hour", "ts").alias("created_at"), F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("consumed_at"),
    )


SQL_JOURNAL = """
journal AS (SELECT CAST(floor(user_id / 10) AS BIGINT) AS owner_id, 'undo_' || event_id AS operation_id, date_trunc('hour', ts) AS created_at, CASE WHEN event_id % 3 <> 0 THEN ts END AS consumed_at FROM events)"""


@query("journal_keep_n", b.with_ctes(SQL_JOURNAL, select="SELECT owner_id, operation_id FROM journal QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, operation_id DESC) <= 20"))
def journal_keep_n(spark, sf_dir):
    return review.keep_newest(journal(spark, sf_dir)).select("owner_id", "operation_id")


@query("latest_operation", b.with_ctes(SQL_JOURNAL, select="SELECT owner_id, arg_max(operation_id, (created_at, operation_id)) AS operation_id FROM journal WHERE consumed_at IS NULL GROUP BY 1"))
def latest_operation(spark, sf_dir):
    return review.latest_operation(journal(spark, sf_dir))


# ------------------------------------------------------------------------------- routing
TEMPLATES = [
    "How much did I spend on groceries in FY 2000-01?", "cash flow for 2000/01 please", "What did I pay at {brand}?!", "transactions from {name}, please",
    "tax 80c evidence 2000-01", "Why was txn_{key}-a classified so", "review backlog", "my recurring charges in 2001-02", "net position 2001-02",
    "select * from ledger", "expense on loan emi", "  ", "why is merchant {brand} here", "spend on premium with {brand}", "hra and tax in 1999-00", "hello there",
]


def questions(spark, sf_dir):
    p = b.table(spark, sf_dir, "part")
    template = F.get(F.array(*[F.lit(t) for t in TEMPLATES]), (F.col("p_partkey") % len(TEMPLATES)).cast("int"))
    filled = F.replace(F.replace(F.replace(template, F.lit("{brand}"), F.col("p_brand")), F.lit("{name}"), F.col("p_name")), F.lit("{key}"), F.col("p_partkey").cast("string"))
    asked = p.select(
        F.concat(F.lit("p"), "p_partkey").alias("question_id"), (F.col("p_partkey") % 40).alias("owner_id"), filled.alias("question")
    )
    talk = b.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("_"), F.col("turn")).alias("question_id"), (F.col("conv_id") % 40).alias("owner_id"), F.col("text").alias("question")
    )
    return asked.unionByName(talk)


def sql_hint() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(q, '{regex}') THEN '{name}'" for regex, name in fv.QUESTION_CATEGORIES) + " END"


SQL_ROUTED = f"""
questions AS (SELECT 'p' || p_partkey AS question_id, p_partkey % 40 AS owner_id, replace(replace(replace({TEMPLATES!r}[p_partkey % {len(TEMPLATES)} + 1], '{{brand}}', p_brand), '{{name}}', p_name), '{{key}}', p_partkey::VARCHAR) AS question FROM part
  UNION ALL SELECT 'c' || conv_id || '_' || turn, conv_id % 40, text FROM conversations),
asked AS (SELECT *, regexp_replace(lower(question), '^\\s+|\\s+$', '', 'g') AS q FROM questions),
hints AS (SELECT *, {sql_hint()} AS category_hint, nullif(trim(regexp_replace(regexp_extract(q, '{fv.QUESTION_MERCHANT_PATTERN}', 1), '[?.!,]+$', '')), '') AS merchant_hint,
  nullif(regexp_extract(q, '{fv.QUESTION_TXN_PATTERN}', 1), '') AS txn_hint, regexp_extract(q, '{fv.QUESTION_PERIOD_PATTERN}', 1) AS y, regexp_extract(q, '{fv.QUESTION_PERIOD_PATTERN}', 2) AS z FROM asked),
tools AS (SELECT *, CASE WHEN q = '' OR regexp_matches(q, '{fv.UNSAFE_QUESTION_PATTERN}') THEN 'unsupported' WHEN regexp_matches(q, '{fv.REVIEW_QUESTION_PATTERN}') THEN 'review_queue'
    WHEN regexp_matches(q, '{fv.SUBSCRIPTION_QUESTION_PATTERN}') THEN 'subscriptions' WHEN regexp_matches(q, '{fv.TAX_QUESTION_PATTERN}') THEN 'tax_evidence'
    WHEN regexp_matches(q, '{fv.PROVENANCE_QUESTION_PATTERN}') THEN 'provenance' WHEN regexp_matches(q, '{fv.CASHFLOW_QUESTION_PATTERN}') THEN 'cashflow'
    WHEN regexp_matches(q, '{fv.SPEND_QUESTION_PATTERN}') AND category_hint IS NOT NULL THEN 'category_spend' WHEN merchant_hint IS NOT NULL THEN 'merchant_search' ELSE 'unsupported' END AS tool FROM hints),
routed AS (SELECT question_id, owner_id, tool, CASE WHEN tool IN ('cashflow', 'category_spend', 'merchant_search', 'tax_evidence', 'subscriptions') AND y <> '' THEN y || '-' || z END AS fy,
    CASE WHEN tool = 'tax_evidence' THEN upper(nullif(regexp_extract(q, '{fv.QUESTION_SECTION_PATTERN}', 1), '')) END AS section, CASE WHEN tool = 'category_spend' THEN category_hint END AS category,
    CASE WHEN tool = 'merchant_search' OR (tool = 'provenance' AND txn_hint IS NULL) THEN merchant_hint END AS merchant, CASE WHEN tool = 'provenance' THEN txn_hint END AS txn_id FROM tools)"""
ROUTED = ["question_id", "owner_id", "tool", "fy", "section", "category", "merchant", "txn_id"]


@query("route_questions", b.with_ctes(SQL_ROUTED, select=f"SELECT {', '.join(ROUTED)} FROM routed"))
def route_questions(spark, sf_dir):
    return routing.route(questions(spark, sf_dir)).select(*ROUTED)


ANSWERED = ["owner_id", "txn_id", "fy_key", "flow", "category", "amount", "merchant", "raw_description", "tax_section"]


@query(
    "answer_batch",
    on_lines(
        """SELECT question_id, tool, CASE tool WHEN 'review_queue' THEN true WHEN 'unsupported' THEN false WHEN 'cashflow' THEN n > 0 ELSE coalesce(n, 0) > 0 END AS answered,
          CASE WHEN tool IN ('cashflow', 'category_spend', 'tax_evidence') AND n > 0 THEN total END::BIGINT AS total,
          CASE WHEN tool = 'review_queue' THEN n WHEN tool = 'cashflow' OR n = 0 THEN NULL WHEN tool = 'merchant_search' THEN least(n, 25) WHEN tool = 'provenance' THEN least(n, 10) ELSE n END::BIGINT AS items
        FROM (
          SELECT question_id, tool, count(l.txn_id) AS n, CASE WHEN tool = 'cashflow' THEN coalesce(sum(amount) FILTER (WHERE l.flow = 'income'), 0) - abs(coalesce(sum(amount) FILTER (WHERE l.flow = 'expense'), 0)) - abs(coalesce(sum(amount) FILTER (WHERE l.flow = 'investment'), 0)) ELSE sum(abs(amount)) END AS total
          FROM routed r LEFT JOIN ledger_lines l ON l.owner_id = r.owner_id AND (r.fy IS NULL OR r.fy = l.fy_key) AND CASE tool WHEN 'cashflow' THEN true WHEN 'category_spend' THEN l.category = r.category
            WHEN 'tax_evidence' THEN l.tax_section IS NOT NULL AND (r.section IS NULL OR r.section = upper(l.tax_section))
            WHEN 'merchant_search' THEN contains(lower(coalesce(l.merchant, '')), replace(replace(r.merchant, '%', ''), '_', '')) OR contains(lower(l.raw_description), replace(replace(r.merchant, '%', ''), '_', ''))
            WHEN 'provenance' THEN r.txn_id = l.txn_id OR contains(lower(coalesce(l.merchant, '')), r.merchant) ELSE false END
          WHERE tool NOT IN ('review_queue', 'subscriptions') GROUP BY question_id, tool
          UNION ALL SELECT question_id, tool, (SELECT count(*) FROM review_items i WHERE i.owner_id = r.owner_id AND status = 'open'), NULL FROM routed r WHERE tool = 'review_queue'
          UNION ALL SELECT question_id, tool, (SELECT count(*) FROM subscriptions a WHERE a.owner_id = r.owner_id), NULL FROM routed r WHERE tool = 'subscriptions')""",
        SQL_ROUTED,
        SQL_OPEN_ITEMS,
        b.SQL_ORDERS,
        SQL_CHARGES,
        SQL_CANDIDATES,
        SQL_SUBSCRIPTIONS,
    ),
)
def answer_batch(spark, sf_dir):
    # written once: every kind of fact reads it
    ledger, _ = stored(b.ledger_lines(spark, sf_dir).select(*ANSWERED), "ledger")
    evidence = ledger.filter("tax_section is not null").select("owner_id", "fy_key", F.upper("tax_section").alias("section"), F.abs("amount").alias("amount"))
    subscriptions = recurrence.detect_subscriptions(charges(spark, sf_dir))
    return routing.answer(routing.route(questions(spark, sf_dir)), ledger, evidence, subscriptions, review_items(spark, sf_dir))
