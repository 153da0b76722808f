"""Scorecards: ledger health, labelled accuracy and rule-pack validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import text
from ledgerloom.operators.dedup import KEY, with_key


def orphaned(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows whose account id no longer exists."""
    live = accounts.select("owner_id", F.col("account_id").alias("own_account_id"))
    return ledger.filter("own_account_id is not null").join(live, ["owner_id", "own_account_id"], "left_anti")


def ledger_health(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """(owner_id, metric, key, value) rows: counters, duplicate groups and histograms."""
    live = accounts.select("owner_id", F.col("account_id").alias("own_account_id"), F.lit(True).alias("live"))
    rows = ledger.join(live, ["owner_id", "own_account_id"], "left")
    missing = F.coalesce("own_account_id", F.lit("")) == ""
    category = F.lower(F.coalesce("category", F.lit("")))
    counters = {
        "transactions": F.count("*"),
        "attributed": F.count_if(~missing & F.col("live").isNotNull()),
        "missing_account": F.count_if(missing),
        "orphaned_account": F.count_if(~missing & F.col("live").isNull()),
        "uncategorised": F.count_if(category.isin("", "uncategorised")),
        "in_review": F.count_if("review_required"),
        "suspected_transfers": F.count_if("suspected_transfer"),
        "internal_transfers": F.count_if("is_internal_transfer"),
    }
    counted = rows.groupBy("owner_id").agg(*[value.alias(name) for name, value in counters.items()])
    totals = _unpivot(counted, list(counters))
    groups = with_key(ledger).groupBy(*KEY).agg(F.count("*").alias("rows")).filter("rows > 1")
    duplicates = _unpivot(
        groups.groupBy("owner_id").agg(F.count("*").alias("duplicate_groups"), F.sum(F.col("rows") - 1).alias("duplicate_excess")),
        ["duplicate_groups", "duplicate_excess"],
    )
    # one pass for all histograms: each row contributes one (metric, key) per dimension
    dimensions = F.array(
        *[
            F.struct(F.lit(metric).alias("metric"), F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("key"))
            for metric, column in (("confidence", "confidence"), ("source", "source"), ("layer", "layer"), ("period", "fy_key"))
        ]
    )
    histograms = ledger.select("owner_id", F.inline(dimensions)).groupBy("owner_id", "metric", "key").agg(F.count("*").alias("value"))
    return totals.unionByName(duplicates).unionByName(histograms)


def _unpivot(wide: DataFrame, names: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.lit("").alias("key"), F.col(n).alias("value")) for n in names])
    return wide.select("owner_id", F.inline(rows))


def accuracy_by_layer(classified: DataFrame, expected: DataFrame) -> DataFrame:
    """Agreement of verdicts with labelled flow, canonical category and review flag."""
    want = expected.select("txn_id", *[F.col(c).alias(f"want_{c}") for c in ("flow", "category", "review_required")])
    rows = classified.select("txn_id", "verdict.*").join(want, "txn_id")
    same_category = text.normalize_category(F.col("category")) == text.normalize_category(F.col("want_category"))
    return rows.groupBy("layer").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("flow") == F.col("want_flow")).alias("flow_ok"),
        F.count_if(same_category).alias("category_ok"),
        F.count_if(F.col("review_required") == F.col("want_review_required")).alias("review_ok"),
    )


# ----------------------------------------------------------------------- pack validation
def _violations(rows: DataFrame, label: Column, checks: dict[str, Column]) -> DataFrame:
    """One row per failed check; a check that evaluates to null has failed."""
    found = F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda v: v.isNotNull()
    )
    return rows.select(label.alias("label"), F.explode(found).alias("violation"))


def _present(name: str) -> Column:
    return F.trim(F.col(name)) != ""


def _all_present(items: Column) -> Column:
    return F.forall(items, lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))


def validate_seed_rows(rows: DataFrame) -> DataFrame:
    """Provider, issuer, product or merchant rows of a pack: (label, violation)."""
    checks = {f"missing {name}": _present(name) for name in ("id", "display_name", "legal_name", "category")}
    checks["id is not a slug"] = F.col("id").isNull() | F.col("id").rlike(fv.SLUG_PATTERN)
    checks["empty alias"] = F.col("aliases").isNotNull() & _all_present(F.col("aliases"))
    checks["confidence domain"] = F.col("confidence").isin(fv.PACK_CONFIDENCES)
    checks["status domain"] = F.col("status").isin(fv.PACK_STATUSES)
    checks["no sources"] = F.size("sources") > 0
    per_row = _violations(rows, F.col("id"), checks)
    sources = rows.select("id", F.posexplode("sources").alias("no", "source")).select("id", "no", "source.*")
    source_checks = {
        "source type domain": F.col("source_type").isin(fv.PACK_SOURCE_TYPES),
        "missing source name": _present("name"),
        "url is not https": F.col("url").startswith("https://"),
        "retrieved_at format": F.col("retrieved_at").rlike(fv.PACK_RETRIEVED_PATTERN),
    }
    label = F.concat(F.col("id"), F.lit(".sources["), F.col("no"), F.lit("]"))
    return per_row.unionByName(_violations(sources, label, source_checks))


def duplicate_ids(rows: DataFrame) -> DataFrame:
    repeated = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    return repeated.select(F.col("id").alias("label"), F.lit("duplicate id").alias("violation"))


def unknown_references(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    ids = known.select(F.col("id").alias(column)).distinct()
    return rows.join(ids, column, "left_anti").select(F.col("id").alias("label"), F.lit(f"unknown {column}").alias("violation"))


def validate_templates(templates: DataFrame, known: DataFrame) -> DataFrame:
    """Message templates: required strings, slug ids, array fields, mandatory fragments, references."""
    lists = ["sender_hints", "subject_hints", "query_fragments", "attachment_mime_hints", "password_rule_tags"]
    checks = {f"missing {name}": _present(name) for name in ("id", "provider_id", "doc_type")}
    checks["id is not a slug"] = F.col("id").isNull() | F.col("id").rlike(fv.SLUG_PATTERN)
    checks.update({f"empty entry in {name}": F.col(name).isNotNull() & _all_present(F.col(name)) for name in lists})
    required = [F.array_contains("query_fragments", f) for f in fv.PACK_REQUIRED_FRAGMENTS]
    checks["missing mandatory fragment"] = reduce(lambda a, b: a & b, required)
    found = _violations(templates, F.col("id"), checks)
    return found.unionByName(duplicate_ids(templates)).unionByName(unknown_references(templates, "provider_id", known))
