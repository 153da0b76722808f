"""Learned labels: centroid-softmax head, predictions, confidence gates and the feedback loop.

Examples: owner_id, example_id, merchant, flow, category, subcategory, institution_id,
embedding array<double>, embedding_model_id. A head is one row per owner and label; scoring
meets slices of an owner's rows with the owner's head in one matrix product each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ledgerloom import fixed_values as fv
from ledgerloom.functions import money, text, vectors
from ledgerloom.operators import tables
from ledgerloom.operators.rollups import top_per
from ledgerloom.session import checkpointed

LABEL = ["flow", "category", "subcategory"]
BLOCK_VECTORS = 2_000
DISTRIBUTION = ArrayType(
    StructType(
        [
            StructField("order", DoubleType()), *[StructField(c, StringType()) for c in ("label_id", *LABEL)],
            StructField("probability", DoubleType()),
        ]
    )
)


def label_id() -> Column:
    return F.concat_ws("|", "flow", "category", F.coalesce("subcategory", F.lit("")))


# ------------------------------------------------------------------------------ training
def pool_tokens(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Masked mean of token vectors (keys, mask, vector), then unit length."""
    pooled = vectors.mean_vectors(tokens.filter("mask <> 0"), keys, F.col("vector"), "vector")
    return pooled.withColumn("vector", vectors.l2_normalize(F.col("vector")))


def train_head(examples: DataFrame, dimensions: int, model_id: str) -> DataFrame:
    """Per owner and label: unit mean of the unit example vectors, and the log share of examples.

    Only vectors of the model and size that `head_metadata` describes count; others are embedded anew first.
    """
    usable = examples.filter((F.size("embedding") == dimensions) & (F.col("embedding_model_id") == model_id)).withColumn("label_id", label_id())
    counts = usable.groupBy("owner_id", "label_id", *LABEL).agg(F.count("*").alias("examples"))
    totals = counts.groupBy("owner_id").agg(F.sum("examples").alias("all_examples"))
    centroids = vectors.mean_vectors(usable, ["owner_id", "label_id"], vectors.l2_normalize(F.col("embedding")), "centroid")
    return (
        counts.join(centroids, ["owner_id", "label_id"]).join(totals, "owner_id")
        .select(
            "owner_id", "label_id", *LABEL, "examples", "all_examples",
            vectors.l2_normalize(F.col("centroid")).alias("weight"),
            F.log(F.col("examples") / F.col("all_examples")).alias("bias"),
        )
    )


def head_metadata(examples: DataFrame, dimensions: int, model_id: str) -> DataFrame:
    """What a stored head was trained on: example count and an order-free digest of the examples."""
    usable = examples.filter((F.size("embedding") == dimensions) & (F.col("embedding_model_id") == model_id))
    shown = F.transform("embedding", lambda x: F.format_string("%.8f", x))
    digest = F.sha2(F.concat_ws("|", "example_id", label_id(), "merchant", F.array_join(shown, ",")), 256)
    share = F.conv(F.substring(digest, 1, 12), 16, 10).cast("decimal(38,0)")
    return usable.groupBy("owner_id").agg(
        F.count("*").alias("example_count"), F.sha2(F.sum(share).cast("string"), 256).alias("checksum")
    ).withColumns({"dimensions": F.lit(dimensions), "embedding_model_id": F.lit(model_id)})


def needs_rebuild(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Owners whose head is missing, stale, of another model or size, or trained on another count."""
    old = stored.select(
        "owner_id", "stale", F.col("embedding_model_id").alias("old_model"), F.col("dimensions").alias("old_dimensions"),
        F.col("example_count").alias("old_count"),
    )
    same = (
        ~F.col("stale") & (F.col("old_model") == F.col("embedding_model_id"))
        & (F.col("old_dimensions") == F.col("dimensions")) & (F.col("old_count") == F.col("example_count"))
    )
    return current.join(old, "owner_id", "left").withColumn("rebuild", ~F.coalesce(same, F.lit(False))).select(
        *current.columns, "rebuild"
    )


def embed_backfill(examples: DataFrame, dimensions: int, model_id: str) -> DataFrame:
    """Examples that need a vector: missing, of another size, or from another model."""
    usable = (F.size("embedding") == dimensions) & (F.col("embedding_model_id") == model_id)
    wanted = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("merchant", "raw_description", "institution_id")])
    return examples.filter(~F.coalesce(usable, F.lit(False))).withColumn("embedding_text", wanted)


# ------------------------------------------------------------------------------- scoring
def _scores(left: pa.Table, right: pa.Table) -> pa.Table:
    """One slice of an owner's rows against the owner's head, as one matrix product; adds `distribution`, best label first."""
    right = right.sort_by("label_id")
    weight = right.column("weight").to_pylist()
    dimensions = len(weight[0]) if weight else -1
    vectors_ = left.column("embedding").combine_chunks()
    size = pc.fill_null(pc.list_value_length(vectors_), -2).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(vectors_)
    holes = np.bincount(pc.list_parent_indices(vectors_).to_numpy()[flat.is_null().to_numpy(zero_copy_only=False)], minlength=len(left)) > 0
    fits = (size == dimensions) & ~holes
    fitting = pc.list_flatten(vectors_.filter(pa.array(fits))).to_numpy(zero_copy_only=False)
    matrix = fitting.astype(float).reshape(int(fits.sum()), max(dimensions, 0))
    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    unit = np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm != 0)
    if weight and len(unit):
        logits = unit @ np.array(weight, float).T * fv.SOFTMAX_TEMPERATURE + right.column("bias").to_numpy()
        chances = np.exp(logits - logits.max(axis=1, keepdims=True))
        chances /= chances.sum(axis=1, keepdims=True)
    else:
        chances = np.zeros((len(unit), len(weight)))
    # stable, so that equal chances stay in the order of label_id
    order = np.argsort(-chances, axis=1, kind="stable")
    ranked = np.take_along_axis(chances, order, axis=1).ravel()
    picked = pa.array(order.ravel())
    fields = {
        "order": pa.array(-ranked),
        **{c: right.column(c).cast(pa.string()).combine_chunks().take(picked) for c in ("label_id", *LABEL)},
        "probability": pa.array(np.floor(ranked * 1_000_000 + 0.5) / 1_000_000),
    }
    ends = np.concatenate([[0], np.cumsum(np.where(fits, len(weight), 0))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)), mask=pa.array(~fits))
    return left.append_column("distribution", lists)


def predict(rows: DataFrame, head: DataFrame) -> DataFrame:
    """Adds winner label, probability, margin and the ranked distribution to rows with `embedding`.

    An owner's rows are cut into slices; each meets the owner's head, one row per label, in one task. Rows without a head,
    a vector or one of the head's size come back with nulls, and so keep their base verdict.
    """
    sizes = rows.groupBy("owner_id").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("_slices"))
    mine = F.coalesce(F.pmod(F.xxhash64("txn_id"), F.col("_slices")).cast("int"), F.lit(0))
    sliced = rows.join(sizes, "owner_id", "left").withColumn("_slice", mine).drop("_slices").select(*rows.columns, "_slice")
    heads = head.select("owner_id", "label_id", *LABEL, "weight", "bias").join(sizes, "owner_id").select(
        "owner_id", "label_id", *LABEL, "weight", "bias", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice")
    )
    schema = StructType([*sliced.schema, StructField("distribution", DISTRIBUTION)])
    cut = ["owner_id", "_slice"]
    scored = sliced.groupBy(*cut).cogroup(heads.groupBy(*cut)).applyInArrow(_scores, schema).drop("_slice")
    first, second = F.get(F.col("distribution"), F.lit(0)), F.get(F.col("distribution"), F.lit(1))
    return scored.withColumns(
        {
            "label_id": first["label_id"],
            **{f"predicted_{c}": first[c] for c in LABEL},
            "probability": first["probability"],
            "margin": vectors.round6(F.coalesce(second["order"], F.lit(0.0)) - first["order"]),
        }
    )


def count_evidence(predicted: DataFrame, examples: DataFrame, model_id: str, dimensions: int) -> DataFrame:
    """Adds evidence (compatible examples of the winning label) and any_compatible.

    Evidence needs a vector of the head's size, any_compatible just a vector.

    Compatibility only looks at model, flow against sign, and institution when both are known, so
    counts per (label, institution) answer it without meeting single examples.
    """
    usable = examples.filter((F.col("embedding_model_id") == model_id) & F.col("embedding").isNotNull()).withColumns(
        {"label_id": label_id(), "institution_key": F.coalesce("institution_id", F.lit(""))}
    )
    per = usable.filter(F.size("embedding") == dimensions).groupBy("owner_id", "label_id", "institution_key").agg(F.count("*").alias("n"))
    whole = per.groupBy("owner_id", "label_id").agg(
        F.sum("n").alias("label_all"), F.coalesce(F.sum(F.when(F.col("institution_key") == "", F.col("n"))), F.lit(0)).alias("label_open")
    )
    exact = per.filter("institution_key <> ''").withColumnRenamed("n", "label_exact")
    side = F.when(F.col("flow") == "income", "credit").when(F.col("flow").isin("expense", "investment"), "debit")
    by_side = usable.withColumn("fits", side).filter("fits is not null")
    side_whole = by_side.groupBy("owner_id", "fits").agg(
        F.count("*").alias("side_all"), F.count_if(F.col("institution_key") == "").alias("side_open")
    )
    side_exact = by_side.filter("institution_key <> ''").groupBy("owner_id", "fits", "institution_key").agg(F.count("*").alias("side_exact"))
    rows = predicted.withColumns(
        {"institution_key": F.coalesce("institution_id", F.lit("")), "fits": F.when(F.col("amount") > 0, "credit").otherwise("debit")}
    )
    rows = (
        rows.join(whole, ["owner_id", "label_id"], "left").join(exact, ["owner_id", "label_id", "institution_key"], "left")
        .join(side_whole, ["owner_id", "fits"], "left").join(side_exact, ["owner_id", "fits", "institution_key"], "left")
    )
    zero = F.lit(0).cast("bigint")

    def compatible(kind: str) -> Column:
        known = F.coalesce(f"{kind}_open", zero) + F.coalesce(f"{kind}_exact", zero)
        return F.when(F.col("institution_key") == "", F.coalesce(f"{kind}_all", zero)).otherwise(known)

    helpers = ["institution_key", "fits"] + [f"{k}_{c}" for k in ("label", "side") for c in ("all", "open", "exact")]
    return rows.withColumns({"evidence": compatible("label"), "any_compatible": compatible("side") > 0}).drop(*helpers)


def nearest_examples(predicted: DataFrame, examples: DataFrame, model_id: str, k: int = 5) -> DataFrame:
    """The k most similar compatible examples of each row's winning label: (txn_id, position, ...).

    Labels are cut into blocks of examples and slices of rows; each (block, slice) is scored in one
    matrix product and keeps k per row, so neither side of a label is gathered in one task and no
    pair outside a block's best k is emitted.
    """
    keyed = examples.filter((F.col("embedding_model_id") == model_id) & F.col("embedding").isNotNull()).withColumn("label_id", label_id())
    rows = predicted.filter("label_id is not null").select("owner_id", "label_id", "txn_id", F.coalesce("institution_id", F.lit("")).alias("institution"), "embedding")

    def pieces(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("owner_id", "label_id").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias(name))

    sizes = pieces(keyed, "blocks").join(pieces(rows, "slices"), ["owner_id", "label_id"])
    cut = ["owner_id", "label_id", "block", "slice"]

    def scattered(df: DataFrame, own: str, own_count: str, other: str, other_count: str, key: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), F.col(own_count)).cast("int").alias(own)
        copies = F.explode(F.sequence(F.lit(0), F.col(other_count) - 1)).alias(other)
        return df.join(sizes, ["owner_id", "label_id"]).select("*", mine).select("*", copies).drop("blocks", "slices")

    queries = scattered(rows, "slice", "slices", "block", "blocks", "txn_id")
    pool = scattered(
        keyed.select("owner_id", "label_id", "example_id", "merchant", F.coalesce("institution_id", F.lit("")).alias("institution"), "embedding"),
        "block", "blocks", "slice", "slices", "example_id",
    )

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["owner_id", "txn_id", "example_id", "merchant", "score"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        right = right.sort_values("example_id", kind="stable").reset_index(drop=True)
        size = len(left["embedding"].iat[0])
        right = right[right["embedding"].map(len) == size].reset_index(drop=True)

        def unit(column: pd.Series) -> np.ndarray:
            matrix = np.stack(column.to_list()).astype(float)
            norm = np.linalg.norm(matrix, axis=1, keepdims=True)
            return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)

        scores = np.floor(unit(left["embedding"]) @ unit(right["embedding"]).T * 1e6 + 0.5) / 1e6
        mine, theirs = left["institution"].to_numpy()[:, None], right["institution"].to_numpy()[None, :]
        clash = (mine != "") & (theirs != "") & (mine != theirs)
        scores = np.where(clash, -np.inf, scores)
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        r, c = np.repeat(np.arange(len(left)), order.shape[1]), order.ravel()
        out = pd.DataFrame(
            {
                "owner_id": left["owner_id"].to_numpy()[r], "txn_id": left["txn_id"].to_numpy()[r],
                "example_id": right["example_id"].to_numpy()[c], "merchant": right["merchant"].to_numpy()[c],
                "score": scores[r, c],
            }
        )
        return out[np.isfinite(out["score"])]

    found = queries.groupBy(*cut).cogroup(pool.groupBy(*cut)).applyInPandas(
        best, "owner_id bigint, txn_id string, example_id string, merchant string, score double"
    )
    return top_per(found, ["owner_id", "txn_id"], [F.desc("score"), F.col("example_id")], k, "position")


# ----------------------------------------------------------------------------- decisions
def eligible(verdict: Column) -> Column:
    """Only weak verdicts outside transfers, tax tags, projects and the strong layers are re-labelled."""
    strong = [fv.LAYER_OVERRIDE, fv.LAYER_PROFILE, fv.LAYER_PROVIDER, fv.LAYER_ALIAS, fv.LAYER_TRANSFER, fv.LAYER_PROJECT]
    blocked = (
        (verdict["flow"] == "transfer") | F.coalesce(verdict["is_internal_transfer"], F.lit(False))
        | (F.coalesce(verdict["tax_section"], F.lit("")) != "") | (F.coalesce(verdict["project_id"], F.lit("")) != "")
        | verdict["layer"].isin(strong)
    )
    return ~blocked & (verdict["review_required"] | (verdict["confidence"] == "low") | (verdict["layer"] == fv.LAYER_FALLBACK))


def confidence(probability: Column, evidence: Column, margin: Column) -> Column:
    high = (evidence >= fv.MIN_EVIDENCE) & (probability >= fv.MIN_SCORE) & (margin >= fv.MIN_MARGIN)
    return F.when(high, "high").when(probability >= fv.MED_SCORE, "med").otherwise("low")


def decide(
    rows: DataFrame,
    min_evidence: int = fv.MIN_EVIDENCE,
    min_score: float = fv.MIN_SCORE,
    min_margin: float = fv.MIN_MARGIN,
    allowed: list[str] | None = None,
) -> DataFrame:
    """Adds has_prediction, prediction_confidence, final, source and review_status.

    `rows`: verdict, amount, and (null where not scored) predicted_*, probability, margin,
    evidence, any_compatible and nearest_merchant. Looser options than the built-in gate have no
    effect, because acceptance also needs the built-in 'high'.
    """
    v = F.col("verdict")
    fits = money.flow_fits_sign(F.col("amount"), F.col("predicted_flow"), False)
    has = F.coalesce(eligible(v) & F.col("any_compatible") & fits, F.lit(False))
    sure = confidence(F.col("probability"), F.col("evidence"), F.col("margin"))
    accept = (
        has & (sure == "high") & (F.col("evidence") >= min_evidence) & (F.col("probability") >= min_score)
        & (F.col("margin") >= min_margin) & F.col("predicted_category").isin(fv.AUTO_ACCEPT_CATEGORIES if allowed is None else allowed)
    )
    accepted = F.coalesce(accept, F.lit(False))
    merchant = F.coalesce("nearest_merchant", "predicted_category")
    relabelled = v
    for name, value in {
        "flow": F.col("predicted_flow"), "category": F.col("predicted_category"), "subcategory": F.col("predicted_subcategory"),
        "merchant": merchant, "confidence": F.lit("high"), "reason": F.concat(F.lit("labelled like "), merchant),
        "signal": F.lit("local_ml.minilm"), "layer": F.lit(fv.LAYER_LABEL_MODEL), "review_required": F.lit(False),
    }.items():
        relabelled = relabelled.withField(name, value)
    waiting = F.when(has, F.when(sure == "low", "required").otherwise("suggested")).otherwise(
        F.when(v["review_required"], "required").otherwise("none")
    )
    return rows.withColumns(
        {
            "has_prediction": has,
            "prediction_confidence": F.when(has, sure),
            "predicted_merchant": F.when(has, merchant),
            "final": F.when(accepted, relabelled).otherwise(v),
            "source": F.when(accepted, "local_ml").otherwise("deterministic"),
            "review_status": F.when(accepted, "accepted").otherwise(waiting),
        }
    )


def label_step(
    rows: DataFrame, vectors_: DataFrame, examples: DataFrame, dimensions: int, model_id: str, model_version: str = fv.LABEL_MODEL_VERSION
) -> DataFrame:
    """Adds final, source and prediction_id to classified rows (with `verdict`); none of them is lost.

    Only rows whose verdict may be replaced and that have a vector (`vectors_`: owner_id, txn_id, embedding) are scored.
    All others, and those without a head or a compatible example, keep their verdict.
    """
    weak = rows.filter(eligible(F.col("verdict"))).select("owner_id", "txn_id", "amount", "institution_id", "verdict")
    weak = checkpointed(weak.join(vectors_.select("owner_id", "txn_id", "embedding"), ["owner_id", "txn_id"]))
    found = checkpointed(predict(weak, train_head(examples, dimensions, model_id)))
    nearest = nearest_examples(found, examples, model_id, k=1).select("owner_id", "txn_id", F.col("merchant").alias("nearest_merchant"))
    decided = decide(count_evidence(found, examples, model_id, dimensions).join(nearest, ["owner_id", "txn_id"], "left"))
    chosen = decided.filter("has_prediction").select(
        "owner_id", "txn_id", F.col("final").alias("_final"), F.col("source").alias("_source"),
        text.stable_id(120, "pred", F.col("txn_id"), model_version).alias("prediction_id"),
    )
    return rows.join(chosen, ["owner_id", "txn_id"], "left").withColumns(
        {"final": F.coalesce("_final", "verdict"), "source": F.coalesce("_source", F.lit("deterministic"))}
    ).drop("_final", "_source")


def prediction_rows(decided: DataFrame, model_version: str = fv.LABEL_MODEL_VERSION) -> DataFrame:
    """Stored predictions of decided rows; transfers are left out by the caller."""
    verdict = (
        F.when(F.col("source") == "local_ml", "accepted").when(F.col("review_status") == "suggested", "suggested")
        .when(F.col("prediction_confidence") == "low", "stored").otherwise("suggested")
    )
    return decided.filter("has_prediction").select(
        "owner_id", text.stable_id(120, "pred", F.col("txn_id"), model_version).alias("prediction_id"), "txn_id",
        "predicted_merchant", *[f"predicted_{c}" for c in LABEL], "probability",
        F.col("prediction_confidence").alias("confidence"), verdict.alias("decision"),
    )


def suggestion_rows(decided: DataFrame, model_version: str = fv.LABEL_MODEL_VERSION) -> DataFrame:
    return decided.filter("has_prediction and review_status = 'suggested'").select(
        "owner_id", text.stable_id(120, "sug", F.col("txn_id"), model_version).alias("suggestion_id"),
        text.stable_id(120, "pred", F.col("txn_id"), model_version).alias("prediction_id"), "txn_id",
        F.lit("open").alias("status"),
    )


def record_predictions(stored: DataFrame, decided: DataFrame) -> DataFrame:
    fresh = prediction_rows(decided)
    return tables.upsert(stored, fresh, ["owner_id", "prediction_id"], [c for c in fresh.columns if c not in ("owner_id", "prediction_id", "txn_id")])


def record_suggestions(stored: DataFrame, decided: DataFrame) -> DataFrame:
    """A repeated suggestion is opened again, whatever became of it before."""
    return tables.upsert(stored, suggestion_rows(decided), ["owner_id", "suggestion_id"], ["prediction_id", "txn_id", "status"])


def example_rows(feedback: DataFrame) -> DataFrame:
    """Training examples of feedback (owner_id, txn_id, raw_description, merchant, flow, category,
    subcategory, amount, institution_id, feedback_source)."""
    source = F.col("feedback_source")
    return feedback.select(
        "owner_id",
        text.stable_id(120, "ex", source, F.col("txn_id")).alias("example_id"),
        text.stable_id(120, "fb", source, F.col("txn_id")).alias("feedback_id"),
        "txn_id", text.signature(F.col("raw_description")).alias("signature"), "merchant",
        text.merchant_tokens(F.concat_ws(" ", "merchant", "raw_description")).alias("merchant_tokens"),
        *LABEL, "amount", money.amount_bucket(F.col("amount")).alias("amount_bucket"),
        money.direction(F.col("amount")).alias("direction"), "institution_id", source.alias("feedback_source"),
    )


def feedback_rows(feedback: DataFrame) -> DataFrame:
    """Stored form of feedback (columns as for `example_rows`): one row per source and transaction."""
    source = F.col("feedback_source")
    return feedback.select(
        "owner_id", text.stable_id(120, "fb", source, F.col("txn_id")).alias("feedback_id"), "txn_id",
        text.signature(F.coalesce("raw_description", F.lit(""))).alias("signature"), "merchant", *LABEL, "amount", source.alias("feedback_source"),
    )


def mark_stale(heads: DataFrame, touched: DataFrame) -> DataFrame:
    """Heads of owners whose training set changed; `needs_rebuild` trains them again before their next use."""
    owners = touched.select("owner_id").distinct().withColumn("_touched", F.lit(True))
    return heads.join(owners, "owner_id", "left").withColumn(
        "stale", F.col("stale") | F.coalesce("_touched", F.lit(False))
    ).select(*heads.columns)


# ------------------------------------------------------------------- accept and reject
def open_suggestions(suggestions: DataFrame, predictions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Open suggestions with their prediction and transaction."""
    wanted = predictions.drop("txn_id")
    rows = ledger.select("owner_id", "txn_id", "raw_description", "amount", "institution_id")
    return suggestions.filter("status = 'open'").join(wanted, ["owner_id", "prediction_id"]).join(rows, ["owner_id", "txn_id"])


def accept_into_ledger(ledger: DataFrame, accepted: DataFrame) -> DataFrame:
    """Transactions of accepted suggestions take the prediction's labels."""
    taken = {
        "merchant": F.col("predicted_merchant"), "flow": F.col("predicted_flow"), "category": F.col("predicted_category"),
        "subcategory": F.col("predicted_subcategory"), "confidence": F.col("confidence"),
        "signal": F.lit("local_ml.memory"), "layer": F.lit(fv.LAYER_LABEL_MODEL), "source": F.lit("local_ml"),
        "accepted_prediction_id": F.col("prediction_id"), "review_required": F.lit(False),
    }
    new = accepted.select("owner_id", "txn_id", F.struct(*[v.alias(k) for k, v in taken.items()]).alias("_new"))
    joined = ledger.join(new, ["owner_id", "txn_id"], "left")
    hit = F.col("_new").isNotNull()
    changes = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in taken if c in ledger.columns}
    return joined.withColumns(changes).drop("_new").select(*ledger.columns)


def override_rows(accepted: DataFrame) -> DataFrame:
    """One rule per signature of the accepted rows (the latest transaction id speaks for it)."""
    sig = text.signature(F.coalesce("raw_description", F.lit("")))
    rows = accepted.withColumn("match_signature", sig).filter("match_signature <> ''").groupBy("owner_id", "match_signature").agg(
        F.max_by(F.struct("predicted_merchant", "predicted_category", "predicted_subcategory", "predicted_flow"), "txn_id").alias("p")
    )
    return rows.select(
        "owner_id", "match_signature", F.nullif("p.predicted_merchant", F.lit("")).alias("merchant"),
        text.normalize_category(F.col("p.predicted_category")).alias("category"),
        F.col("p.predicted_subcategory").alias("subcategory"),
        F.when(F.col("p.predicted_flow") == "transfer", "transfer").alias("flow"),
    )


def accepted_feedback(accepted: DataFrame) -> DataFrame:
    """Feedback of accepted suggestions, as `example_rows` takes it."""
    return accepted.select(
        "owner_id", "txn_id", F.coalesce("raw_description", F.lit("")).alias("raw_description"), F.col("predicted_merchant").alias("merchant"),
        *[F.col(f"predicted_{c}").alias(c) for c in LABEL], "amount", "institution_id", F.lit("suggestion_accept").alias("feedback_source"),
    )


def close(table: DataFrame, ids: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """Sets one column on the rows whose key is listed."""
    marked = ids.select("owner_id", key).distinct().withColumn("_hit", F.lit(True))
    return table.join(marked, ["owner_id", key], "left").withColumn(
        column, F.when(F.col("_hit").isNotNull(), value).otherwise(F.col(column))
    ).drop("_hit").select(*table.columns)
