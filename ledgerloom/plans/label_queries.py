"""Learned-label queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import money, text, vectors
from ledgerloom.operators import labels
from ledgerloom.operators import rules
from ledgerloom.plans import bindings as b
from ledgerloom.plans.registry import query

DIMENSIONS = 64
MODEL = "m1"
# label number -> flow, category, subcategory
LABELS = [
    ("income", "Salary", None), ("expense", "Groceries", "weekly"), ("expense", "Dining", None), ("expense", "Transport", "cabs"),
    ("investment", "Investment", "sip"), ("expense", "Groceries", "snacks"), ("income", "Refund", None), ("expense", "Health", None),
    ("expense", "Odd", None), ("expense", "Travel", "air"),
]


def labelled(spark, sf_dir, pull=0):
    """`pull` moves every vector towards an axis of its label, some more than others; without it few rows are told apart surely."""
    e = b.table(spark, sf_dir, "embeddings")
    key = F.col("vec_id")
    drawn = F.lit(float(pull)) * (key % 4)
    rows = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(labels.LABEL, label)]) for label in LABELS])
    return e.select(
        (key % 2).alias("owner_id"), key.alias("vec_id"), F.get(rows, F.col("label")).alias("of"),
        F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == F.col("label"), drawn).otherwise(0.0)).alias("embedding"),
        F.when(key % 3 != 2, F.concat(F.lit("i"), key % 3)).alias("institution_id"),
        F.concat(F.lit("M"), key % 17).alias("merchant"),
    ).select("*", "of.*").drop("of")


def examples(spark, sf_dir, pull=0):
    return labelled(spark, sf_dir, pull).filter("vec_id % 5 <> 0").withColumns(
        {
            "example_id": F.concat(F.lit("ex"), F.lpad(F.col("vec_id").cast("string"), 9, "0")),
            "embedding_model_id": F.when(F.col("vec_id") % 20 == 7, "other").otherwise(MODEL),
            "raw_description": F.concat(F.lit("UPI/"), F.col("vec_id"), F.lit("/"), "category", F.lit(" shop")),
        }
    ).drop("vec_id")


def transactions(spark, sf_dir, pull=0):
    rows = labelled(spark, sf_dir, pull).filter("vec_id % 5 = 0")
    key = F.col("vec_id")
    credit = (F.col("flow") == "income") != (key % 35 == 0)
    layer = F.when(key % 25 == 0, 4).when(key % 10 == 0, 7).otherwise(5)
    return rows.select(
        "owner_id", F.concat(F.lit("t"), key).alias("txn_id"), "embedding", "institution_id",
        F.when(credit, key * 100 + 50).otherwise(-(key * 100 + 50)).alias("amount"),
        F.concat(F.lit("UPI/"), key, F.lit("/"), "category", F.lit(" shop "), "merchant").alias("raw_description"),
        rules.verdict(
            F.lit(True), flow=F.when(credit, "income").otherwise("expense"), category="Uncategorised", confidence="low",
            reason="weak", layer=layer, review_required=key % 15 != 0,
        ).alias("verdict"),
    )


def sql_label(field: int) -> str:
    values = ", ".join("NULL" if label[field] is None else f"'{label[field]}'" for label in LABELS)
    return f"[{values}][label + 1]"


SQL_LABELLED = f"""
labelled AS (SELECT vec_id % 2 AS owner_id, vec_id, {sql_label(0)} AS flow, {sql_label(1)} AS category, {sql_label(2)} AS subcategory,
  embedding::DOUBLE[] AS embedding, CASE WHEN vec_id % 3 <> 2 THEN 'i' || (vec_id % 3) END AS institution_id, 'M' || (vec_id % 17) AS merchant FROM embeddings),
unit AS (SELECT *, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS u, flow || '|' || category || '|' || coalesce(subcategory, '') AS label_id FROM labelled),
examples AS (SELECT *, 'ex' || lpad(vec_id::VARCHAR, 9, '0') AS example_id, CASE WHEN vec_id % 20 = 7 THEN 'other' ELSE 'm1' END AS embedding_model_id FROM unit WHERE vec_id % 5 <> 0),
txns AS (SELECT owner_id, 't' || vec_id AS txn_id, u, institution_id, credit, (CASE WHEN credit THEN 1 ELSE -1 END * (vec_id * 100 + 50))::BIGINT AS amount,
    CASE WHEN vec_id % 25 = 0 THEN 4 WHEN vec_id % 10 = 0 THEN 7 ELSE 5 END AS layer, vec_id % 15 <> 0 AS review_required,
    'UPI/' || vec_id || '/' || category || ' shop ' || merchant AS raw_description, merchant, category
  FROM (SELECT *, (flow = 'income') <> (vec_id % 35 = 0) AS credit FROM unit WHERE vec_id % 5 = 0)),
dims AS (SELECT unnest(range(1, {DIMENSIONS + 1})) AS d),
trained AS (SELECT * FROM examples WHERE embedding_model_id = 'm1'),
means AS (SELECT owner_id, label_id, d, avg(u[d]) AS v FROM trained, dims GROUP BY ALL),
head AS (SELECT c.owner_id, c.label_id, c.flow, c.category, c.subcategory, c.n AS examples, ln(c.n / (SELECT count(*) FROM trained e WHERE e.owner_id = c.owner_id)) AS bias,
    list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS weight
  FROM (SELECT owner_id, label_id, flow, category, subcategory, count(*)::BIGINT AS n FROM trained GROUP BY ALL) c
  JOIN (SELECT owner_id, label_id, list(v ORDER BY d) AS w FROM means GROUP BY ALL) m USING (owner_id, label_id))"""

SQL_SCORES = """
logits AS (SELECT t.owner_id, t.txn_id, h.label_id, h.flow, h.category, h.subcategory, 8 * list_dot_product(t.u, h.weight) + h.bias AS logit FROM txns t JOIN head h USING (owner_id)),
chances AS (SELECT *, exp(logit - max(logit) OVER w) / sum(exp(logit - (SELECT max(logit) FROM logits))) OVER w * exp(max(logit) OVER w - (SELECT max(logit) FROM logits)) AS p
  FROM logits WINDOW w AS (PARTITION BY owner_id, txn_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY owner_id, txn_id ORDER BY p DESC, label_id) AS r, lead(p) OVER (PARTITION BY owner_id, txn_id ORDER BY p DESC, label_id) AS p2 FROM chances),
winners AS (SELECT owner_id, txn_id, label_id, flow AS predicted_flow, category AS predicted_category, subcategory AS predicted_subcategory,
  floor(p * 1000000 + 0.5) / 1000000 AS probability, floor((p - coalesce(p2, 0)) * 1000000 + 0.5) / 1000000 AS margin FROM ranked WHERE r = 1)"""

SQL_DECIDED = f"""
alike AS (SELECT t.owner_id, t.txn_id, e.example_id, e.merchant, floor(list_dot_product(t.u, e.u) * 1000000 + 0.5) / 1000000 AS score
  FROM winners w JOIN txns t USING (owner_id, txn_id) JOIN examples e ON e.owner_id = w.owner_id AND e.label_id = w.label_id AND e.embedding_model_id = 'm1'
    AND NOT coalesce(e.institution_id <> t.institution_id, false)),
nearest AS (SELECT *, (row_number() OVER (PARTITION BY owner_id, txn_id ORDER BY score DESC, example_id))::INT AS position FROM alike QUALIFY position <= 5),
evidence AS (SELECT t.owner_id, t.txn_id, (SELECT count(*) FROM alike s WHERE s.owner_id = t.owner_id AND s.txn_id = t.txn_id)::BIGINT AS evidence,
  EXISTS (SELECT 1 FROM examples e WHERE e.owner_id = t.owner_id AND e.embedding_model_id = 'm1' AND NOT coalesce(e.institution_id <> t.institution_id, false)
    AND CASE WHEN t.amount > 0 THEN e.flow = 'income' ELSE e.flow IN ('expense', 'investment') END) AS any_compatible FROM txns t),
gated AS (SELECT *, layer NOT IN (1, 2, 3, 4, 8, 9) AND any_compatible AND CASE WHEN amount > 0 THEN predicted_flow = 'income' ELSE predicted_flow IN ('expense', 'investment') END AS has_prediction,
    CASE WHEN evidence >= 2 AND probability >= 0.9 AND margin >= 0.65 THEN 'high' WHEN probability >= 0.45 THEN 'med' ELSE 'low' END AS sure
  FROM txns JOIN winners USING (owner_id, txn_id) JOIN evidence USING (owner_id, txn_id)),
decided AS (SELECT *, has_prediction AND sure = 'high' AND predicted_category IN ({', '.join(repr(c) for c in fv.AUTO_ACCEPT_CATEGORIES)}) AS accepted,
    CASE WHEN accepted THEN 'accepted' WHEN has_prediction THEN CASE WHEN sure = 'low' THEN 'required' ELSE 'suggested' END WHEN review_required THEN 'required' ELSE 'none' END AS review_status
  FROM gated),
predictions AS (SELECT owner_id, substr(regexp_replace('pred_' || txn_id || '_{fv.LABEL_MODEL_VERSION}', '[^a-zA-Z0-9_-]', '_', 'g'), 1, 120) AS prediction_id, d.txn_id, n.merchant AS predicted_merchant,
    predicted_flow, predicted_category, predicted_subcategory, probability, sure AS confidence,
    CASE WHEN accepted THEN 'accepted' WHEN review_status = 'suggested' THEN 'suggested' WHEN sure = 'low' THEN 'stored' ELSE 'suggested' END AS decision, review_status
  FROM decided d LEFT JOIN (SELECT owner_id, txn_id, merchant FROM nearest WHERE position = 1) n USING (owner_id, txn_id) WHERE has_prediction)"""


def on_labels(select: str, *ctes: str) -> str:
    return b.with_ctes(SQL_LABELLED, *ctes, select=select)


@query("pool_embeddings", "SELECT owner_id, d::INT AS dim, floor(v / norm * 1000000 + 0.5) / 1000000 AS value FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY owner_id)) AS norm FROM (SELECT label AS owner_id, d - 1 AS d, avg(embedding[d]::DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS d) WHERE vec_id % 4 <> 0 GROUP BY ALL))")
def pool_embeddings(spark, sf_dir):
    tokens = b.table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("owner_id"), F.when(F.col("vec_id") % 4 != 0, 1).otherwise(0).alias("mask"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
    )
    pooled = labels.pool_tokens(tokens, ["owner_id"])
    return pooled.select("owner_id", F.posexplode("vector").alias("dim", "value")).withColumn("value", vectors.round6(F.col("value")))


@query(
    "train_head",
    on_labels("SELECT owner_id, label_id, examples, d - 1 AS dim, floor(weight[d] * 1000000 + 0.5) / 1000000 AS weight, floor(bias * 1000000 + 0.5) / 1000000 AS bias FROM head, dims"),
)
def train_head(spark, sf_dir):
    head = labels.train_head(examples(spark, sf_dir), DIMENSIONS, MODEL)
    rows = head.select("owner_id", "label_id", "examples", "bias", F.posexplode("weight").alias("dim", "weight"))
    return rows.withColumns({"dim": F.col("dim").cast("bigint"), "weight": vectors.round6(F.col("weight")), "bias": vectors.round6(F.col("bias"))})


def predicted(spark, sf_dir, pull=0):
    head = labels.train_head(examples(spark, sf_dir, pull), DIMENSIONS, MODEL)
    return labels.predict(transactions(spark, sf_dir, pull), head)


WINNER = ["owner_id", "txn_id", "label_id", "predicted_flow", "predicted_category", "predicted_subcategory", "probability", "margin"]


@query("predict_head", on_labels(f"SELECT {', '.join(WINNER)} FROM winners", SQL_SCORES))
def predict_head(spark, sf_dir):
    return predicted(spark, sf_dir).select(*WINNER)


@query("ranked_distribution", on_labels("SELECT owner_id, txn_id, (r - 1)::INT AS position, label_id, floor(p * 1000000 + 0.5) / 1000000 AS probability FROM ranked", SQL_SCORES))
def ranked_distribution(spark, sf_dir):
    rows = predicted(spark, sf_dir).select("owner_id", "txn_id", F.posexplode("distribution").alias("position", "entry"))
    return rows.select("owner_id", "txn_id", "position", "entry.label_id", "entry.probability")


@query("nearest_examples", on_labels("SELECT owner_id, txn_id, position, example_id, merchant, score FROM nearest", SQL_SCORES, SQL_DECIDED))
def nearest_examples(spark, sf_dir):
    found = labels.nearest_examples(predicted(spark, sf_dir), examples(spark, sf_dir), MODEL)
    return found.select("owner_id", "txn_id", "position", "example_id", "merchant", "score")


@query("example_compat", on_labels("SELECT owner_id, txn_id, evidence, any_compatible FROM evidence", SQL_SCORES, SQL_DECIDED))
def example_compat(spark, sf_dir):
    counted = labels.count_evidence(predicted(spark, sf_dir), examples(spark, sf_dir), MODEL, DIMENSIONS)
    return counted.select("owner_id", "txn_id", "evidence", "any_compatible")


def decided(spark, sf_dir):
    rows = predicted(spark, sf_dir)
    known = examples(spark, sf_dir)
    nearest = labels.nearest_examples(rows, known, MODEL, k=1).select("owner_id", "txn_id", F.col("merchant").alias("nearest_merchant"))
    return labels.decide(labels.count_evidence(rows, known, MODEL, DIMENSIONS).join(nearest, ["owner_id", "txn_id"], "left"))


@query("confidence_gate", on_labels("SELECT owner_id, txn_id, sure AS confidence FROM gated", SQL_SCORES, SQL_DECIDED))
def confidence_gate(spark, sf_dir):
    rows = labels.count_evidence(predicted(spark, sf_dir), examples(spark, sf_dir), MODEL, DIMENSIONS)
    sure = labels.confidence(F.col("probability"), F.col("evidence"), F.col("margin"))
    return rows.select("owner_id", "txn_id", sure.alias("confidence"))


@query("ml_eligible", on_labels("SELECT txn_id, layer NOT IN (1, 2, 3, 4, 8, 9) AS eligible FROM txns"))
def ml_eligible(spark, sf_dir):
    return transactions(spark, sf_dir).select("txn_id", labels.eligible(F.col("verdict")).alias("eligible"))


@query(
    "decide_labels",
    on_labels(
        """SELECT d.txn_id, has_prediction, review_status, CASE WHEN accepted THEN 'local_ml' ELSE 'deterministic' END AS source,
        CASE WHEN accepted THEN predicted_category ELSE 'Uncategorised' END AS category, CASE WHEN accepted THEN 10 ELSE layer END::INT AS layer FROM decided d""",
        SQL_SCORES,
        SQL_DECIDED,
    ),
)
def decide_labels(spark, sf_dir):
    return decided(spark, sf_dir).select("txn_id", "has_prediction", "review_status", "source", "final.category", "final.layer")


PULL = 1
STRICT = ["Groceries", "Salary", "Travel"]


def on_pulled(select: str, *ctes: str) -> str:
    moved = f"list_transform(embedding::DOUBLE[], lambda x, i: x + CASE WHEN i = label + 1 THEN {PULL} * (vec_id % 4) ELSE 0 END) AS embedding"
    return b.with_ctes(SQL_LABELLED.replace("embedding::DOUBLE[] AS embedding", moved), *ctes, select=select)


def _gate(name, gate, options):
    """A query of the decisions under a gate's options, over vectors that are told apart well enough for some to pass."""

    @query(
        name,
        on_pulled(
            f"""SELECT txn_id, CASE WHEN accepted THEN 'local_ml' ELSE 'deterministic' END AS source,
            CASE WHEN accepted THEN 'accepted' WHEN has_prediction THEN CASE WHEN sure = 'low' THEN 'required' ELSE 'suggested' END
              WHEN review_required THEN 'required' ELSE 'none' END AS review_status
            FROM (SELECT *, has_prediction AND sure = 'high' AND {gate} AS accepted FROM gated)""",
            SQL_SCORES,
            SQL_DECIDED,
        ),
    )
    def run(spark, sf_dir):
        counted = labels.count_evidence(predicted(spark, sf_dir, PULL), examples(spark, sf_dir, PULL), MODEL, DIMENSIONS)
        done = labels.decide(counted.withColumn("nearest_merchant", F.lit(None).cast("string")), **options)
        return done.select("txn_id", "source", "review_status")

    return run


def _listed(categories):
    return f"predicted_category IN ({', '.join(repr(c) for c in categories)})"


_gate("decide_labels_sure", _listed(fv.AUTO_ACCEPT_CATEGORIES), {})
_gate("decide_labels_strict", "probability >= 0.985 AND margin >= 0.98 AND evidence >= 4", {"min_evidence": 4, "min_score": 0.985, "min_margin": 0.98, "allowed": [c for _, c, _ in LABELS]})
_gate("decide_labels_listed", _listed(STRICT), {"allowed": STRICT})


PREDICTION = ["owner_id", "prediction_id", "txn_id", "predicted_merchant", "predicted_flow", "predicted_category", "predicted_subcategory", "probability", "confidence", "decision"]


@query(
    "record_decisions",
    on_labels(
        f"""SELECT {', '.join(PREDICTION)} FROM predictions
        UNION ALL SELECT owner_id, 'old_' || txn_id, txn_id, 'x', 'expense', 'Old', NULL, 0.5, 'med', 'stored' FROM txns WHERE amount % 3 = 0""",
        SQL_SCORES,
        SQL_DECIDED,
    ),
)
def record_decisions(spark, sf_dir):
    done = decided(spark, sf_dir)
    fresh = labels.prediction_rows(done)
    # stored before: some of today's rows with another decision, and rows of an older model
    again = fresh.filter("probability > 0.2").withColumns({"decision": F.lit("stored"), "confidence": F.lit("low")})
    older = transactions(spark, sf_dir).filter("amount % 3 = 0").select(
        "owner_id", F.concat(F.lit("old_"), "txn_id").alias("prediction_id"), "txn_id", F.lit("x").alias("predicted_merchant"),
        F.lit("expense").alias("predicted_flow"), F.lit("Old").alias("predicted_category"), F.lit(None).cast("string").alias("predicted_subcategory"),
        F.lit(0.5).alias("probability"), F.lit("med").alias("confidence"), F.lit("stored").alias("decision"),
    )
    return labels.record_predictions(again.unionByName(older), done).select(*PREDICTION)


SQL_SUGGESTIONS = f"""
suggestions AS (SELECT owner_id, 'sug' || substr(prediction_id, 5) AS suggestion_id, prediction_id, txn_id FROM predictions)"""


def all_suggestions(spark, sf_dir):
    """Every prediction as a suggestion; a quarter of them already settled."""
    p = labels.prediction_rows(decided(spark, sf_dir))
    number = F.substr("txn_id", F.lit(2)).cast("bigint")
    return p.select(
        "owner_id", F.concat(F.lit("sug"), F.substr("prediction_id", F.lit(5))).alias("suggestion_id"), "prediction_id", "txn_id",
        F.when(number % 4 == 0, "rejected").otherwise("open").alias("status"),
    )


@query(
    "record_suggestions",
    on_labels(
        """SELECT s.suggestion_id, CASE WHEN p.review_status = 'suggested' OR substr(s.txn_id, 2)::BIGINT % 4 <> 0 THEN 'open' ELSE 'rejected' END AS status
        FROM suggestions s JOIN predictions p USING (owner_id, prediction_id)""",
        SQL_SCORES, SQL_DECIDED, SQL_SUGGESTIONS,
    ),
)
def record_suggestions(spark, sf_dir):
    return labels.record_suggestions(all_suggestions(spark, sf_dir), decided(spark, sf_dir)).select("suggestion_id", "status")


@query(
    "open_suggestions",
    on_labels(
        """SELECT suggestion_id, s.txn_id, p.predicted_category, p.confidence, t.amount FROM suggestions s JOIN predictions p USING (owner_id, prediction_id)
        JOIN txns t ON t.owner_id = s.owner_id AND t.txn_id = s.txn_id WHERE substr(s.txn_id, 2)::BIGINT % 4 <> 0""",
        SQL_SCORES, SQL_DECIDED, SQL_SUGGESTIONS,
    ),
)
def open_suggestions(spark, sf_dir):
    p = labels.prediction_rows(decided(spark, sf_dir))
    found = labels.open_suggestions(all_suggestions(spark, sf_dir), p, transactions(spark, sf_dir))
    return found.select("suggestion_id", "txn_id", "predicted_category", "confidence", "amount")


SQL_ACCEPTED = """
chosen AS (SELECT s.owner_id, s.suggestion_id, s.txn_id, p.* EXCLUDE (owner_id, txn_id), t.raw_description FROM suggestions s JOIN predictions p USING (owner_id, prediction_id)
  JOIN txns t ON t.owner_id = s.owner_id AND t.txn_id = s.txn_id WHERE substr(s.txn_id, 2)::BIGINT % 4 = 1)"""


def accepted(spark, sf_dir):
    p = labels.prediction_rows(decided(spark, sf_dir))
    found = labels.open_suggestions(all_suggestions(spark, sf_dir), p, transactions(spark, sf_dir))
    return found.filter(F.substr("txn_id", F.lit(2)).cast("bigint") % 4 == 1)


@query(
    "suggestion_accept",
    on_labels(
        """SELECT t.txn_id, coalesce(c.predicted_category, 'Uncategorised') AS category, CASE WHEN c.txn_id IS NULL THEN t.layer ELSE 10 END::INT AS layer,
        c.prediction_id AS accepted_prediction_id, t.review_required AND c.txn_id IS NULL AS review_required
        FROM txns t LEFT JOIN chosen c ON c.owner_id = t.owner_id AND c.txn_id = t.txn_id""",
        SQL_SCORES, SQL_DECIDED, SQL_SUGGESTIONS, SQL_ACCEPTED,
    ),
)
def suggestion_accept(spark, sf_dir):
    ledger = transactions(spark, sf_dir).select(
        "owner_id", "txn_id", "verdict.*"
    ).withColumns({"source": F.lit("deterministic"), "accepted_prediction_id": F.lit(None).cast("string")})
    done = labels.accept_into_ledger(ledger, accepted(spark, sf_dir))
    return done.select("txn_id", "category", "layer", "accepted_prediction_id", "review_required")


@query(
    "suggestion_override",
    on_labels(
        f"""SELECT owner_id, {b.sql_signature('raw_description')} AS match_signature, arg_max(predicted_merchant, txn_id) AS merchant,
        arg_max(lower(predicted_category), txn_id) AS raw_category FROM chosen GROUP BY ALL""",
        SQL_SCORES, SQL_DECIDED, SQL_SUGGESTIONS, SQL_ACCEPTED,
    ),
)
def suggestion_override(spark, sf_dir):
    rows = accepted(spark, sf_dir)
    chosen = rows.groupBy("owner_id", text.signature(F.col("raw_description")).alias("match_signature")).agg(
        F.max_by(F.lower("predicted_category"), "txn_id").alias("raw_category")
    )
    return labels.override_rows(rows).join(chosen, ["owner_id", "match_signature"]).select("owner_id", "match_signature", "merchant", "raw_category")


@query(
    "suggestion_feedback",
    on_labels(
        f"""SELECT {b.sql_capped("'ex_suggestion_accept_' || c.txn_id", 120)} AS example_id, c.predicted_merchant AS merchant, c.predicted_flow AS flow,
        c.predicted_category AS category, {b.sql_signature('c.raw_description')} AS signature FROM chosen c""",
        SQL_SCORES, SQL_DECIDED, SQL_SUGGESTIONS, SQL_ACCEPTED,
    ),
)
def suggestion_feedback(spark, sf_dir):
    told = labels.example_rows(labels.accepted_feedback(accepted(spark, sf_dir)))
    return told.select("example_id", "merchant", "flow", "category", "signature")


@query(
    "suggestion_reject",
    on_labels(
        """SELECT s.suggestion_id, CASE WHEN n % 4 IN (0, 2) THEN 'rejected' ELSE 'open' END AS status, CASE WHEN n % 4 = 2 THEN 'rejected' ELSE p.decision END AS decision
        FROM (SELECT *, substr(txn_id, 2)::BIGINT AS n FROM suggestions) s JOIN predictions p USING (owner_id, prediction_id)""",
        SQL_SCORES, SQL_DECIDED, SQL_SUGGESTIONS,
    ),
)
def suggestion_reject(spark, sf_dir):
    suggestions = all_suggestions(spark, sf_dir)
    refused = suggestions.filter((F.substr("txn_id", F.lit(2)).cast("bigint") % 4 == 2) & (F.col("status") == "open"))
    closed = labels.close(suggestions, refused, "suggestion_id", "status", "rejected")
    p = labels.close(labels.prediction_rows(decided(spark, sf_dir)), refused, "prediction_id", "decision", "rejected")
    return closed.join(p.select("owner_id", "prediction_id", "decision"), ["owner_id", "prediction_id"]).select("suggestion_id", "status", "decision")


def feedback(spark, sf_dir):
    rows = b.ledger_lines(spark, sf_dir).filter("review_required")
    return rows.select(
        "owner_id", "txn_id", "raw_description", F.coalesce("merchant", F.lit("")).alias("merchant"), "flow", "category", "subcategory",
        "amount", "institution_id", F.lit("review_assignment").alias("feedback_source"),
    )


@query(
    "feedback_write",
    b.with_ctes(
        b.SQL_LINES,
        select=f"""SELECT substr(regexp_replace('ex_review_assignment_' || txn_id, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 120) AS example_id,
        {b.sql_signature('raw_description')} AS signature,
        list_aggregate(list_filter(string_split({b.sql_signature("coalesce(merchant, '') || ' ' || raw_description")}, ' '), lambda t: length(t) >= 3 AND NOT list_contains({fv.TOKEN_STOPWORDS!r}, t)), 'string_agg', ' ') AS tokens,
        CASE WHEN amount >= 0 THEN 'income:' ELSE 'expense:' END || CASE WHEN r < 100 THEN '0-100' WHEN r < 500 THEN '100-500' WHEN r < 1000 THEN '500-1000' WHEN r < 5000 THEN '1000-5000' WHEN r < 25000 THEN '5000-25000' ELSE '25000+' END AS amount_bucket,
        CASE WHEN amount >= 0 THEN 'credit' ELSE 'debit' END AS direction
        FROM (SELECT *, {b.sql_major('abs(amount)')} AS r FROM ledger_lines WHERE review_required)""",
    ),
)
def feedback_write(spark, sf_dir):
    rows = labels.example_rows(feedback(spark, sf_dir))
    return rows.select("example_id", "signature", F.array_join("merchant_tokens", " ").alias("tokens"), "amount_bucket", "direction")


@query(
    "head_refresh",
    on_labels(
        """SELECT owner_id, count(*)::BIGINT AS example_count, NOT (owner_id = 1) AS rebuild FROM examples WHERE embedding_model_id = 'm1' GROUP BY 1"""
    ),
)
def head_refresh(spark, sf_dir):
    now = labels.head_metadata(examples(spark, sf_dir), DIMENSIONS, MODEL)
    stored = now.withColumn("stale", F.col("owner_id") == 0)
    return labels.needs_rebuild(now, stored).select("owner_id", "example_count", "rebuild")


@query(
    "embed_backfill_plan",
    on_labels("SELECT example_id, merchant || ' UPI/' || vec_id || '/' || category || ' shop' || coalesce(' ' || institution_id, '') AS embedding_text FROM examples WHERE embedding_model_id <> 'm1'"),
)
def embed_backfill_plan(spark, sf_dir):
    return labels.embed_backfill(examples(spark, sf_dir), DIMENSIONS, MODEL).select("example_id", "embedding_text")


@query(
    "vector_helpers",
    on_labels("SELECT vec_id, floor(list_dot_product(u, u) * 1000000 + 0.5) / 1000000 AS self_dot, floor(u[1] * 1000000 + 0.5) / 1000000 AS first FROM unit"),
)
def vector_helpers(spark, sf_dir):
    unit = vectors.l2_normalize(F.col("embedding"))
    rows = labelled(spark, sf_dir).withColumn("unit", unit)
    return rows.select("vec_id", vectors.round6(vectors.dot(F.col("unit"), F.col("unit"))).alias("self_dot"), vectors.round6(F.get("unit", F.lit(0))).alias("first"))
