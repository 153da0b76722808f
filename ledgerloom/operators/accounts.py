"""Attribution of documents and their transactions to registered accounts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.operators.rollups import top_per

FAMILY = ["owner_id", "kind", "family"]


def issuer_family(institution: Column) -> Column:
    """A card issuer 'x-cards' and its bank 'x' are one issuer; no institution is its own family."""
    return F.coalesce(F.regexp_replace(institution, "-cards$", ""), F.lit(""))


def all_accounts(banks: DataFrame, cards: DataFrame) -> DataFrame:
    return banks.withColumn("kind", F.lit("bank")).unionByName(cards.withColumn("kind", F.lit("card")))


def resolve_accounts(documents: DataFrame, accounts: DataFrame, learn_last4: bool = False) -> DataFrame:
    """Adds kind, own_account_id, account_source and needs_assignment to every document.

    Documents (owner_id, document_id, seq, institution_id, account_last4, doc_type, txn_count) are
    taken in `seq` order: an account minted for an unregistered number is visible to later ones.
    With `learn_last4`, a single account registered without a number takes the first number seen.
    Every lookup is an aggregate with one row per key, so no document meets more than one row.
    """
    kind = F.when(F.col("doc_type") == "card_statement", "card").otherwise("bank")
    position = F.struct("seq", "document_id")
    docs = documents.withColumns(
        {
            "kind": kind,
            "family": issuer_family(F.col("institution_id")),
            "last4": F.nullif(F.col("account_last4"), F.lit("")),
            "position": position,
        }
    )
    registered = accounts.withColumn("family", issuer_family(F.col("institution_id")))
    families = registered.groupBy(*FAMILY).agg(
        F.count("*").alias("registered"), F.min("account_id").alias("only_account"),
        F.count_if(F.col("last4").isNull()).alias("unnumbered"),
    )
    by_number = registered.filter("last4 is not null").groupBy(*FAMILY, "last4").agg(F.min("account_id").alias("numbered_account"))
    docs = docs.join(families, FAMILY, "left").join(by_number, [*FAMILY, "last4"], "left")
    lone_unnumbered = F.coalesce((F.col("registered") == 1) & (F.col("unnumbered") == 1), F.lit(False))
    has_number = F.col("last4").isNotNull()
    claims_lone = has_number & lone_unnumbered
    if learn_last4:
        learned = docs.filter(claims_lone).groupBy(*FAMILY).agg(
            F.min_by("last4", "position").alias("learned"), F.min("position").alias("learned_at")
        )
        docs = docs.join(learned, FAMILY, "left")
        claims_lone = claims_lone & (F.col("last4") == F.col("learned"))
        lone_source = F.when(F.col("position") == F.col("learned_at"), "institution_unique").otherwise("header_match")
    else:
        lone_source = F.lit("institution_unique")
    wants_stub = has_number & F.col("numbered_account").isNull() & ~claims_lone
    docs = docs.withColumns({"claims_lone": claims_lone, "wants_stub": wants_stub, "lone_source": lone_source})

    stubs = docs.filter("wants_stub").groupBy(*FAMILY, "last4").agg(
        F.min("position").alias("stub_at"), F.min_by("institution_id", "position").alias("stub_institution")
    )
    identity = F.concat_ws("|", "owner_id", F.coalesce("stub_institution", F.lit("")), "kind", "last4")
    prefix = F.when(F.col("kind") == "card", "card_").otherwise("acc_")
    stubs = stubs.withColumn("stub_id", F.concat(prefix, F.substring(F.sha2(identity, 256), 1, 24)))
    # for documents without a number only the first two stubs of a family can matter
    ranked = top_per(stubs, FAMILY, [F.col("stub_at")], 2, "nth").groupBy(*FAMILY).agg(
        F.max(F.when(F.col("nth") == 1, F.col("stub_at"))).alias("first_at"),
        F.max(F.when(F.col("nth") == 1, F.col("stub_id"))).alias("first_stub"),
        F.max(F.when(F.col("nth") == 2, F.col("stub_at"))).alias("second_at"),
    )
    docs = docs.join(stubs, [*FAMILY, "last4"], "left").join(ranked, FAMILY, "left")
    count = F.coalesce("registered", F.lit(0))
    before_stubs = F.coalesce(F.col("position") < F.col("first_at"), F.lit(True))
    between = F.coalesce(F.col("position") > F.col("first_at"), F.lit(False)) & F.coalesce(
        F.col("position") < F.col("second_at"), F.lit(True)
    )
    attributable = ~has_number & F.col("institution_id").isNotNull() & (F.coalesce("txn_count", F.lit(1)) > 0)
    sole_registered = attributable & (count == 1) & before_stubs
    sole_stub = attributable & (count == 0) & between
    account = (
        F.when(has_number & F.col("numbered_account").isNotNull(), F.col("numbered_account"))
        .when(F.col("claims_lone"), F.col("only_account"))
        .when(F.col("wants_stub"), F.col("stub_id"))
        .when(sole_registered, F.col("only_account"))
        .when(sole_stub, F.col("first_stub"))
    )
    source = (
        F.when(has_number & F.col("numbered_account").isNotNull(), "header_match")
        .when(F.col("claims_lone"), F.col("lone_source"))
        .when(F.col("wants_stub"), F.when(F.col("position") == F.col("stub_at"), "stub").otherwise("header_match"))
        .when(sole_registered | sole_stub, "institution_unique")
    )
    return docs.withColumns(
        {
            "own_account_id": account,
            "own_account_kind": F.when(account.isNotNull(), F.col("kind")),
            "account_source": source,
            "needs_assignment": account.isNull(),
        }
    ).select(*documents.columns, "own_account_id", "own_account_kind", "account_source", "needs_assignment")


def minted_stubs(resolved: DataFrame) -> DataFrame:
    """Account rows to add for numbers that were not registered."""
    return resolved.filter("account_source = 'stub'").select(
        "owner_id", F.col("own_account_id").alias("account_id"), F.col("own_account_kind").alias("kind"),
        "institution_id", F.col("account_last4").alias("last4"), F.lit(None).cast("string").alias("nickname"),
    )


def with_stubs(accounts: DataFrame, resolved: DataFrame) -> DataFrame:
    """The account table after a run: its rows, and one stub for each unregistered number that documents named.

    A stub whose id the table already has is not added again, so a rerun changes nothing.
    """
    stubs = minted_stubs(resolved).groupBy("owner_id", "account_id").agg(
        *[F.min(c).alias(c) for c in ("kind", "institution_id", "last4", "nickname")]
    )
    fresh = stubs.join(accounts.select("owner_id", "account_id"), ["owner_id", "account_id"], "left_anti")
    return accounts.unionByName(fresh.select(*[c for c in accounts.columns if c in fresh.columns]), allowMissingColumns=True)


def needing_accounts(documents: DataFrame, accounts: DataFrame) -> DataFrame:
    """Documents without a live account that the user has not assigned by hand."""
    live = accounts.select("owner_id", F.col("account_id").alias("own_account_id"), F.lit(True).alias("live"))
    joined = documents.join(live, ["owner_id", "own_account_id"], "left")
    by_user = F.coalesce(F.col("account_source") == "user_assigned", F.lit(False))
    return joined.filter(~by_user & F.col("live").isNull()).select(*documents.columns)


def backfill_accounts(documents: DataFrame, accounts: DataFrame) -> DataFrame:
    """Re-derived attribution of the documents that need one."""
    pending = needing_accounts(documents, accounts).drop("own_account_id", "own_account_kind", "account_source")
    return resolve_accounts(pending, accounts, learn_last4=True)


def stamp_transactions(ledger: DataFrame, resolved: DataFrame) -> DataFrame:
    """Every transaction of a resolved document takes the document's account."""
    new = resolved.select(
        "owner_id", "document_id", F.col("own_account_id").alias("_account"), F.col("own_account_kind").alias("_kind"),
        F.lit(True).alias("_hit"),
    )
    hit = F.col("_hit").isNotNull()
    return ledger.join(new, ["owner_id", "document_id"], "left").withColumns(
        {
            "own_account_id": F.when(hit, F.col("_account")).otherwise(F.col("own_account_id")),
            "own_account_kind": F.when(hit, F.col("_kind")).otherwise(F.col("own_account_kind")),
        }
    ).drop("_account", "_kind", "_hit")


def assign_accounts(documents: DataFrame, accounts: DataFrame, choices: DataFrame) -> DataFrame:
    """User choices (owner_id, document_id, account_id) for registered accounts only."""
    known = accounts.select("owner_id", "account_id", "kind")
    valid = choices.join(known, ["owner_id", "account_id"]).select(
        "owner_id", "document_id", F.col("account_id").alias("own_account_id"), F.col("kind").alias("own_account_kind"),
        F.lit("user_assigned").alias("account_source"),
    )
    return documents.drop("own_account_id", "own_account_kind", "account_source").join(valid, ["owner_id", "document_id"])


def resolve_items(items: DataFrame, refs: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Marks review items of the given references resolved."""
    done = refs.select("owner_id", "ref_id").distinct().withColumn("_done", F.lit(True))
    hit = F.col("_done").isNotNull()
    if kinds is not None:
        hit = hit & F.col("kind").isin(kinds)
    return items.join(done, ["owner_id", "ref_id"], "left").withColumn(
        "status", F.when(hit, "resolved").otherwise(F.col("status"))
    ).drop("_done").select(*items.columns)


def unassigned_documents(ledger: DataFrame, documents: DataFrame, accounts: DataFrame, attachments: DataFrame) -> DataFrame:
    """Documents whose account is missing or gone, with their rows' count and date range."""
    live = accounts.select("owner_id", F.col("account_id").alias("own_account_id"))
    open_docs = documents.join(live, ["owner_id", "own_account_id"], "left_anti")
    spans = ledger.groupBy("owner_id", "document_id").agg(
        F.count("*").alias("rows"), F.min("txn_date").alias("first_date"), F.max("txn_date").alias("last_date")
    )
    files = attachments.select("attachment_id", "file_name")
    return (
        open_docs.select("owner_id", "document_id", "institution_id", "doc_type", "attachment_id")
        .join(spans, ["owner_id", "document_id"], "left").join(files, "attachment_id", "left")
        .withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint")))
    )


# -------------------------------------------------------------------- profile account sync
CLAIM_SCHEMA = "owner_id bigint, kind string, institution_id string, seed_no bigint, last4 string, account_id string"


def _claim(group: pd.DataFrame) -> pd.DataFrame:
    """Seeds in order: an unclaimed row with the same number, else the only row left if either has none."""
    seeds = group[group["account_id"].isna()].sort_values("seed_no")
    pool = {r.account_id: r.last4 for r in group[group["account_id"].notna()].sort_values("account_id").itertuples()}
    rows = []
    for seed in seeds.itertuples():
        exact = [a for a, number in pool.items() if number == seed.last4 or (number is None and seed.last4 is None)]
        found = exact[0] if exact else None
        if found is None and len(pool) == 1:
            account, number = next(iter(pool.items()))
            found = account if number is None or seed.last4 is None else None
        learned = pool.pop(found, None) if found else None
        rows.append((seed.owner_id, seed.kind, seed.institution_id, seed.seed_no, seed.last4 or learned, found))
    return pd.DataFrame(rows, columns=["owner_id", "kind", "institution_id", "seed_no", "last4", "account_id"])


def claim_by_natural_key(seeds: DataFrame, accounts: DataFrame) -> DataFrame:
    """Each declared account with the stored account it stands for (null: a new one).

    Groups are one owner's accounts of one kind at one institution. They are bounded by the
    distinct four-digit numbers an institution can have there, plus the declared list itself.
    """
    columns = ["owner_id", "kind", "institution_id", "seed_no", "last4", "account_id"]
    both = seeds.withColumn("account_id", F.lit(None).cast("string")).select(*columns).unionByName(
        accounts.withColumn("seed_no", F.lit(None).cast("bigint")).select(*columns)
    )
    return both.groupBy("owner_id", "kind", "institution_id").applyInPandas(_claim, CLAIM_SCHEMA)


def sync_accounts(seeds: DataFrame, accounts: DataFrame, references: DataFrame) -> DataFrame:
    """The account table after a profile save: claimed or new rows, and old rows still referenced."""
    claims = claim_by_natural_key(seeds, accounts)
    minted = F.concat(F.col("kind"), F.lit("_"), F.substring(F.sha2(F.concat_ws("|", "owner_id", "institution_id", "seed_no"), 256), 1, 24))
    declared = claims.select(
        "owner_id", F.coalesce("account_id", minted).alias("account_id"), "kind", "institution_id", "last4",
        F.when(F.col("account_id").isNull(), "new").otherwise("claimed").alias("origin"),
    )
    claimed = claims.filter("account_id is not null").select("owner_id", "account_id")
    left_over = accounts.join(claimed, ["owner_id", "account_id"], "left_anti")
    used = references.select("owner_id", F.col("own_account_id").alias("account_id"))
    kept = left_over.join(used, ["owner_id", "account_id"], "left_semi").select(
        "owner_id", "account_id", "kind", "institution_id", "last4", F.lit("referenced").alias("origin")
    )
    return declared.unionByName(kept)


def missing_references(profile_ids: DataFrame, institutions: DataFrame) -> DataFrame:
    """Institution ids a profile uses that no loaded pack has; a non-empty result rejects the save."""
    known = institutions.select("institution_id").distinct()
    return profile_ids.filter("institution_id is not null").distinct().join(known, "institution_id", "left_anti")


def sync_projects(existing: DataFrame, seeds: DataFrame, ledger: DataFrame) -> DataFrame:
    """Declared projects replace stored ones by id; absent ones stay only while transactions use them."""
    keys = ["owner_id", "project_id"]
    absent = existing.join(seeds.select(*keys), keys, "left_anti")
    in_use = ledger.filter("project_id is not null").select(*keys).distinct()
    return seeds.unionByName(absent.join(in_use, keys, "left_semi"))
