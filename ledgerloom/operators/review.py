"""Review queue, batch assignments, before-images and undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ledgerloom import fixed_values as fv
from ledgerloom.functions import money, text
from ledgerloom.operators import accounts, labels, search, tables
from ledgerloom.operators.rollups import top_per
from ledgerloom.session import checkpointed

FLOWS = list(fv.TAXONOMY)
#: Keys of the tables that an assignment changes and its undo restores.
JOURNALLED_KEYS = {
    "transactions": ["owner_id", "txn_id"], "overrides": ["owner_id", "match_signature"], "aliases": ["owner_id", "alias_id"],
    "feedback": ["owner_id", "feedback_id"], "examples": ["owner_id", "example_id"],
}


# ------------------------------------------------------------------------------- queue
def rebuild_items(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """Items derived from `review_required` are projected afresh; all other kinds stay."""
    described = F.coalesce("raw_description", F.lit("transaction"))
    kind = F.when(F.lower(F.coalesce("category", F.lit(""))) == "uncategorised", "uncategorised").otherwise("low_confidence")
    fresh = ledger.filter("review_required").select(
        text.shortened(F.concat(F.lit("rev_txn_"), "txn_id"), 80).alias("item_id"), "owner_id", kind.alias("kind"),
        F.col("txn_id").alias("ref_id"), F.concat(F.lit("Please check: "), F.substring(described, 1, 48)).alias("title"),
        F.coalesce("reason", F.lit("")).alias("detail"), F.lit("info").alias("severity"), F.lit("open").alias("status"),
    )
    # one item per id, the lowest transaction first
    fresh = top_per(fresh, ["owner_id", "item_id"], [F.col("ref_id")], 1)
    return items.filter(~F.col("kind").isin(fv.REBUILT_REVIEW_KINDS)).unionByName(fresh.select(*items.columns))


def review_groups(ledger: DataFrame, suggestions: DataFrame, contains: str | None = None) -> DataFrame:
    """Pending rows by signature, with the first row's attributes and the best suggestion.

    `suggestions`: owner_id, txn_id and a struct column `suggestion` with a `score` field.
    """
    pending = ledger.filter("review_required").withColumn("described", F.coalesce("raw_description", F.lit("")))
    if contains:
        pending = pending.filter(F.contains(F.lower("described"), F.lit(contains.strip().lower())))
    pending = pending.withColumn("signature", text.signature(F.col("described"))).filter("signature <> ''")
    rows = pending.join(suggestions.select("owner_id", "txn_id", "suggestion"), ["owner_id", "txn_id"], "left")
    kept = ["described", "flow", "amount", "category", "own_account_id", "own_account_kind", "counterparty_raw"]
    suggested = F.when(F.col("suggestion").isNotNull(), F.struct((-F.col("suggestion.score")).alias("s"), F.col("txn_id")))
    groups = rows.groupBy("owner_id", "signature").agg(
        F.count("*").alias("rows"), F.sum(F.abs("amount")).alias("minor"), F.min("txn_date").alias("first_date"),
        F.max("txn_date").alias("last_date"), F.coalesce(F.bool_or("suspected_transfer"), F.lit(False)).alias("suspected_transfer"),
        F.min_by(F.struct(*kept), F.struct("txn_date", "txn_id")).alias("first"), F.min_by("suggestion", suggested).alias("suggestion"),
    )
    by_sign = F.when(F.col("first.amount") < 0, "expense").otherwise("income")
    return groups.select(
        "owner_id", "signature", F.substring(F.trim("first.described"), 1, 80).alias("sample"),
        F.substring(text.title_case(F.col("signature")), 1, 40).alias("suggested_merchant"), "rows", "minor",
        F.coalesce("first.flow", by_sign).alias("flow"), F.nullif(F.col("first.category"), F.lit("Uncategorised")).alias("category"),
        "first_date", "last_date", "first.own_account_id", "first.own_account_kind", "first.counterparty_raw",
        "suspected_transfer", "suggestion",
    )


def top_groups(groups: DataFrame, limit: int = fv.REVIEW_GROUP_LIMIT) -> DataFrame:
    ranked = top_per(groups, ["owner_id"], [F.desc("minor"), F.desc("rows"), F.col("signature")], limit, "position")
    return ranked.withColumn("total", money.to_major(F.col("minor"))).drop("minor")


def shortlist(suggested: Column, distribution: Column, frequent: Column, flow: Column) -> Column:
    """Up to five distinct categories of the flow: suggestion, likely ones, frequent ones, the rest."""
    pools = F.create_map(
        *[x for name, cats in fv.TAXONOMY.items() for x in (F.lit(name), F.array(*[F.lit(c) for c in cats]))]
    )
    pool = F.element_at(pools, F.when(flow.isin(FLOWS), flow).otherwise("income"))
    none = F.array().cast("array<string>")
    valid = F.filter(
        F.coalesce(distribution, F.array().cast("array<struct<category:string,p:double>>")),
        lambda e: e["category"].isNotNull() & e["p"].isNotNull() & ~F.isnan(e["p"]) & (F.abs(e["p"]) < float("inf")),
    )
    placed = F.transform(valid, lambda e, i: F.struct((-e["p"]).alias("order"), i.alias("i"), e["category"].alias("category")))
    likely = F.transform(F.array_sort(placed), lambda e: e["category"])
    named = F.when((suggested.isNotNull()) & (suggested != ""), F.array(text.normalize_category(suggested))).otherwise(none)
    all_ = F.concat(named, likely, F.coalesce(frequent, none), pool)
    return F.slice(F.array_distinct(F.filter(all_, lambda c: F.array_contains(pool, c))), 1, fv.SHORTLIST_SIZE)


def parse_distribution(provenance: Column) -> Column:
    """category and probability pairs from a stored JSON blob; anything malformed is skipped."""
    shape = "struct<distribution:array<struct<category:string,probability:double>>>"
    parsed = F.from_json(provenance, shape, {"mode": "PERMISSIVE"})
    return F.transform(parsed["distribution"], lambda e: F.struct(e["category"].alias("category"), e["probability"].alias("p")))


def frequent_arrays(frequency: DataFrame) -> DataFrame:
    """At most eight categories per owner as one array."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "category")))
    return frequency.groupBy("owner_id").agg(F.transform(ordered, lambda e: e["category"]).alias("frequent"))


def review_queue(ledger: DataFrame, suggestions: DataFrame, accounts: DataFrame, frequency: DataFrame, contains: str | None = None) -> DataFrame:
    """The top groups with account details and a ranked category shortlist."""
    groups = top_groups(review_groups(ledger, suggestions, contains))
    account = accounts.select(
        "owner_id", F.col("account_id").alias("own_account_id"), F.col("kind").alias("own_account_kind"),
        F.col("nickname").alias("account_nickname"), F.col("last4").alias("account_last4"), F.col("institution_id").alias("account_institution"),
    )
    ranked = shortlist(F.col("suggestion.category"), F.col("suggestion.distribution"), F.col("frequent"), F.col("flow"))
    return (
        groups.join(account, ["owner_id", "own_account_id", "own_account_kind"], "left")
        .join(frequent_arrays(frequency), "owner_id", "left").withColumn("ranked", ranked).drop("frequent")
    )


def expand_duplicates(decisions: DataFrame, ledger: DataFrame, messages: DataFrame, contains: str | None = None) -> DataFrame:
    """Both rows of every open duplicate pair; pairs with a missing side are dropped."""
    source = messages.select("message_id", "from_addr", "subject")
    rows = ledger.join(source, "message_id", "left").select(
        "owner_id", "txn_id", "document_id", "txn_date", "amount", F.coalesce("raw_description", F.lit("")).alias("raw_description"),
        "own_account_id", "from_addr", "subject",
    )

    def side(name: str) -> DataFrame:
        return rows.select("owner_id", *[F.col(c).alias(f"{name}_{c}") for c in rows.columns if c != "owner_id"])

    pairs = decisions.filter("status = 'open'").join(side("keeper"), ["owner_id", "keeper_txn_id"]).join(side("candidate"), ["owner_id", "candidate_txn_id"])
    if contains:
        wanted = F.lit(contains.strip().lower())
        pairs = pairs.filter(F.contains(F.lower("keeper_raw_description"), wanted) | F.contains(F.lower("candidate_raw_description"), wanted))
    return pairs.withColumn("amount", money.to_major(F.col("candidate_amount")))


# -------------------------------------------------------------------------- assignments
def prepare_assignments(assignments: DataFrame) -> DataFrame:
    """Normalised user choices: owner_id, seq, signature, merchant, category, subcategory."""
    card = F.lower(F.trim("category")) == "credit card payment"
    category = F.when(card, "Transfer").otherwise(F.trim("category"))
    return assignments.select(
        "owner_id", "seq", F.trim("signature").alias("signature"), F.trim(F.coalesce("merchant", F.lit(""))).alias("merchant"),
        category.alias("category"),
        F.when(card, "Credit card payment").otherwise(F.nullif(F.trim("subcategory"), F.lit(""))).alias("subcategory"),
        F.when(card, "cc_payment").otherwise(text.normalize_category(category)).alias("canonical"),
    )


def alias_tokens(matched: DataFrame) -> DataFrame:
    """Per assignment, the longest usable word of the merchant that every matched text contains."""
    words = F.filter(
        F.array_distinct(F.split(F.lower("merchant"), "[^a-z0-9]+")),
        lambda w: (F.length(w) >= fv.MIN_ALIAS_CHARS) & ~w.isin(fv.ALIAS_TOKEN_STOPWORDS),
    )
    debit_flow = text.flow_for_category(F.col("new_category"), F.lit(-1))
    teachable = matched.filter((F.col("new_category") != "Transfer") & (debit_flow != "transfer"))
    tried = teachable.select("owner_id", "signature", "seq", "described", F.posexplode(words).alias("no", "word"))
    kept = tried.groupBy("owner_id", "signature", "seq", "no", "word").agg(
        F.bool_and(F.contains(F.lower("described"), F.col("word"))).alias("everywhere")
    ).filter("everywhere")
    return kept.groupBy("owner_id", "signature", "seq").agg(F.min_by("word", F.struct(-F.length("word"), "no")).alias("alias_token"))


def assign_batch(ledger: DataFrame, assignments: DataFrame) -> DataFrame:
    """Pending rows an assignment batch changes, with their new values and how they were reached.

    A row whose signature was assigned takes that assignment (the latest of the batch); other
    pending rows that contain a learnt alias token are swept by the first such assignment.
    """
    chosen = top_per(prepare_assignments(assignments), ["owner_id", "signature"], [F.desc("seq")], 1)
    renamed = chosen.select(
        "owner_id", "signature", "seq", F.col("merchant"), F.col("category").alias("new_category"),
        F.col("subcategory").alias("new_subcategory"), "canonical",
    )
    pending = ledger.filter("review_required").withColumn("described", F.coalesce("raw_description", F.lit(""))).withColumn(
        "signature", text.signature(F.col("described"))
    )
    # narrow and written once: matching, teaching and sweeping all read it
    rows = checkpointed(pending.select("owner_id", "txn_id", "amount", "described", "signature"))
    matched = rows.join(renamed, ["owner_id", "signature"])
    tokens = alias_tokens(matched)
    rules = tokens.join(renamed, ["owner_id", "signature", "seq"]).withColumnRenamed("signature", "rule_signature")

    # distinct pending texts are passed once by the learnt tokens of their owner
    rest = rows.join(renamed.select("owner_id", "signature"), ["owner_id", "signature"], "left_anti").withColumn("lowered", F.lower("described"))
    needles = rules.select("owner_id", F.col("alias_token").alias("needle")).distinct()
    found = search.scan(rest.select("owner_id", "lowered").distinct(), needles, ["lowered"])
    payload = F.struct("seq", "merchant", "new_category", "new_subcategory", "canonical", F.col("needle").alias("alias_token"))
    taught = rules.withColumnRenamed("alias_token", "needle").join(found, ["owner_id", "needle"])
    first = taught.groupBy("owner_id", "lowered").agg(F.min(payload).alias("rule"))
    swept = rest.join(first, ["owner_id", "lowered"]).select(
        "owner_id", "txn_id", "amount", "described", "signature", "rule.*", F.lit(fv.LAYER_ALIAS).alias("layer")
    ).distinct()
    direct = matched.join(tokens, ["owner_id", "signature", "seq"], "left").withColumn("layer", F.lit(fv.LAYER_OVERRIDE))
    flow = text.flow_for_category(F.col("new_category"), F.col("amount"))
    return direct.unionByName(swept).withColumn("new_flow", flow)


def apply_assignments(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """The ledger after a batch; `changes` comes from `assign_batch`."""
    values = {
        "merchant": F.nullif(F.col("merchant"), F.lit("")), "category": F.col("canonical"), "subcategory": F.col("new_subcategory"),
        "flow": F.col("new_flow"), "is_internal_transfer": F.col("new_flow") == "transfer", "suspected_transfer": F.lit(False),
        "confidence": F.lit("high"), "layer": F.col("layer"), "source": F.lit("deterministic"),
        "accepted_prediction_id": F.lit(None).cast("string"),
        "reason": F.concat(F.lit("assigned by you: "), F.concat_ws(" / ", F.nullif("merchant", F.lit("")), "new_category", "new_subcategory")),
        "signal": F.when(F.col("layer") == fv.LAYER_OVERRIDE, "user.override").otherwise("user.merchant_alias"),
        "review_required": F.lit(False),
    }
    new = changes.select("owner_id", "txn_id", F.struct(*[v.alias(k) for k, v in values.items()]).alias("_new"))
    joined = ledger.join(new, ["owner_id", "txn_id"], "left")
    hit = F.col("_new").isNotNull()
    updates = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in values if c in ledger.columns}
    return joined.withColumns(updates).drop("_new").select(*ledger.columns)


def assigned_overrides(changes: DataFrame) -> DataFrame:
    """One override row per directly assigned signature; only transfers pin the flow."""
    direct = changes.filter(F.col("layer") == fv.LAYER_OVERRIDE)
    transfer = (text.flow_of_canonical(F.col("new_category")) == "transfer") | (F.col("new_category") == "Transfer")
    return direct.select(
        "owner_id", F.col("signature").alias("match_signature"), F.nullif("merchant", F.lit("")).alias("merchant"),
        F.col("canonical").alias("category"), F.col("new_subcategory").alias("subcategory"),
        F.when(transfer, "transfer").alias("flow"),
    ).distinct()


def assigned_aliases(changes: DataFrame) -> DataFrame:
    """User alias rows learnt from the batch; a token taught twice keeps the latest teaching."""
    taught = changes.filter("alias_token is not null").groupBy("owner_id", "alias_token").agg(
        F.max(F.struct("seq", "merchant", "canonical", "new_subcategory")).alias("t")
    )
    return taught.select(
        "owner_id", F.concat(F.lit("ua_"), "alias_token").alias("alias_id"), F.col("alias_token").alias("pattern"),
        F.col("t.merchant").alias("canonical_merchant"), F.col("t.canonical").alias("category"),
        F.col("t.new_subcategory").alias("subcategory"), F.lit("user").alias("source"), F.lit("high").alias("confidence"),
    )


def assignment_feedback(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """Feedback on the rows assigned directly, as `labels.example_rows` takes it. Rows an alias swept are no human label."""
    direct = changes.filter(F.col("layer") == fv.LAYER_OVERRIDE).select(
        "owner_id", "txn_id", F.col("described").alias("raw_description"), "merchant", F.col("new_flow").alias("flow"),
        F.col("new_category").alias("category"), F.col("new_subcategory").alias("subcategory"), "amount",
        F.lit("review_assignment").alias("feedback_source"),
    )
    return direct.join(ledger.select("owner_id", "txn_id", "institution_id"), ["owner_id", "txn_id"])


def resolve_items(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Items about a changed row are resolved."""
    return accounts.resolve_items(items, changes.select("owner_id", F.col("txn_id").alias("ref_id")))


def assign(state: dict[str, DataFrame], assignments: DataFrame, operation: Column, created_at: Column) -> dict[str, DataFrame]:
    """Every table after a batch of assignments, with the operation in the journal.

    `state`: the tables of JOURNALLED_KEYS, review_items, heads (owner_id, stale, ...), images (of `before_image`) and journal
    (owner_id, operation_id, created_at, consumed_at). Columns of a stored table that the batch says nothing about
    are null in new rows.
    """
    ledger = state["transactions"]
    changes = checkpointed(assign_batch(ledger, assignments))
    feedback = checkpointed(assignment_feedback(ledger, changes))
    fresh = {
        "overrides": assigned_overrides(changes), "aliases": assigned_aliases(changes),
        "feedback": labels.feedback_rows(feedback), "examples": labels.example_rows(feedback),
    }
    after = {"transactions": apply_assignments(ledger, changes)}
    images = state["images"].unionByName(before_image(ledger, changes, JOURNALLED_KEYS["transactions"], "transactions", operation))
    for name, rows in fresh.items():
        stored, keys = state[name], JOURNALLED_KEYS[name]
        rows = checkpointed(rows.select(*[c if c in rows.columns else F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in stored.columns]))
        images = images.unionByName(before_image(stored, rows, keys, name, operation))
        after[name] = tables.upsert(stored, rows, keys, [c for c in stored.columns if c not in keys])
    entry = changes.select("owner_id").distinct().select(
        "owner_id", operation.alias("operation_id"), created_at.alias("created_at"), F.lit(None).cast("timestamp").alias("consumed_at")
    )
    return after | {
        "review_items": resolve_items(state["review_items"], changes),
        "heads": labels.mark_stale(state["heads"], feedback),
        "images": checkpointed(images),  # every table's undo reads them
        "journal": keep_newest(state["journal"].unionByName(entry)),
    }


# ------------------------------------------------------------------------ journal, undo
def before_image(table: DataFrame, touched: DataFrame, keys: list[str], table_name: str, operation: Column) -> DataFrame:
    """What the touched rows of a table look like before a change; `existed` false means it creates them."""
    # the columns are joined, and written as text only for rows that the change touches
    found = touched.select(*keys).distinct().join(table.withColumn("_existed", F.lit(True)), keys, "left")
    existed = F.col("_existed").isNotNull()
    prior = F.when(existed, F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"}))
    return found.select(
        "owner_id", operation.alias("operation_id"), F.lit(table_name).alias("table_name"),
        F.to_json(F.struct(*keys)).alias("row_key"), existed.alias("existed"), prior.alias("prior"),
    )


def restore(table: DataFrame, images: DataFrame, keys: list[str], table_name: str) -> DataFrame:
    """Inverse of the change: created rows go, changed rows come back as they were."""
    shape = StructType([table.schema[k] for k in keys])
    mine = images.filter(F.col("table_name") == table_name).withColumn("_key", F.from_json("row_key", shape)).select(
        *[F.col(f"_key.{k}").alias(k) for k in keys], "existed", "prior"
    )
    untouched = table.join(mine.select(*keys), keys, "left_anti")
    back = mine.filter("existed").select(F.from_json("prior", table.schema).alias("row")).select("row.*")
    return untouched.unionByName(back)


def latest_operation(journal: DataFrame) -> DataFrame:
    """Each owner's newest unconsumed operation: the only one that may be undone."""
    return journal.filter("consumed_at is null").groupBy("owner_id").agg(
        F.max(F.struct("created_at", "operation_id")).alias("latest")
    ).select("owner_id", "latest.operation_id")


def undo(state: dict[str, DataFrame], consumed_at: Column) -> dict[str, DataFrame]:
    """Every journalled table as it was before each owner's newest open operation, which is thereby consumed.

    `state` is that of `assign`. Review items are a projection: the caller rebuilds them from the restored ledger.
    """
    latest = checkpointed(latest_operation(state["journal"]))
    images = checkpointed(state["images"].join(latest, ["owner_id", "operation_id"]))
    after = {name: restore(state[name], images, keys, name) for name, keys in JOURNALLED_KEYS.items()}
    done = state["journal"].join(latest.withColumn("_undone", F.lit(True)), ["owner_id", "operation_id"], "left")
    journal = done.withColumn("consumed_at", F.when(F.col("_undone"), consumed_at).otherwise(F.col("consumed_at")))
    return after | {
        "review_items": state["review_items"], "heads": labels.mark_stale(state["heads"], latest), "images": state["images"],
        "journal": journal.select(*state["journal"].columns),
    }


def keep_newest(journal: DataFrame, limit: int = fv.JOURNAL_KEEP) -> DataFrame:
    return tables.newest(journal, limit)
