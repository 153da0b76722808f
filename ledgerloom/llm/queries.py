"""The operators' queries over the given tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.llm import clustering, fmindex, language, licenses, middles, packing, secrets, sharding, simhash, syncmers, tokens, urls, warc, wordpiece
from ledgerloom.llm.registry import query, table
from ledgerloom.llm.storage import work_folder


@query("op5_simhash")
def op5_simhash(spark, sf_dir):
    """Fingerprint and component of every document: pigeonhole blocks, Hamming check, connected components."""
    classes = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


@query(
    "op7_url_filter",
    """
    WITH rules(action, host, path) AS (
        VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
    ), parsed AS (
        SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
               coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
        FROM pages
    ), places AS (SELECT DISTINCT host, path FROM parsed),
    best AS (
        SELECT p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
               arg_max(r.action, length(r.host || r.path)) AS verdict
        FROM places p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        GROUP BY 1, 2
    )
    SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
    FROM parsed p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
    """,
)
def op7_url_filter(spark, sf_dir):
    """Verdict of every page's url under the production rules."""
    judged = urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query(
    "op9_decontamination",
    r"""
    WITH item_words AS (
        SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark WHERE text IS NOT NULL
    ), phrases AS (
        SELECT DISTINCT item_id, list_slice(w, i, least(i + 9, len(w))) AS phrase
        FROM item_words, unnest(generate_series(1, greatest(1, len(w) - 9))) AS t(i) WHERE len(w) > 0
    ), doc_words AS (
        SELECT doc_id, row_number() OVER () AS r,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents
    ), sizes AS (SELECT DISTINCT len(phrase) AS size FROM phrases),
    windows AS (
        SELECT r, i, size, list_slice(w, i, i + size - 1) AS phrase
        FROM doc_words, sizes, unnest(generate_series(1, len(w) - size + 1)) AS t(i) WHERE len(w) >= size
    ), found AS (SELECT r, i, size, item_id FROM windows JOIN phrases USING (phrase)),
    hit AS (
        SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, size FROM found), unnest(generate_series(i, i + size - 1)) AS t(p) GROUP BY r
    ), owners AS (
        SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r
    )
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc_words LEFT JOIN hit USING (r) LEFT JOIN owners USING (r)
    """,
)
def op9_decontamination(spark, sf_dir):
    """Words of every document that lie inside an occurrence of a ten-word benchmark window."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fmindex.find(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contamination.*")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, hit: total + hit["words"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


@query("op10_secret_scan")
def op10_secret_scan(spark, sf_dir):
    """Secrets of every document by pattern and by sliding-window entropy, with column functions only."""
    found = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    found = found.select("doc_id", "secrets", secrets.listed(base).alias("base"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2("base", 256).alias("base_sha256"), secrets.listed(F.col("secrets")).alias("spans"),
    )


def held_out() -> Column:
    """Documents that no model learns from: the CRC-32 of their id is divisible by 5. A null id teaches nothing either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


@query("op2_language")
def op2_language(spark, sf_dir):
    """Language of every document from a model trained on the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = language.train(docs.where("not held_out").select("text", "lang"))
    return language.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


@query("op6_packing")
def op6_packing(spark, sf_dir):
    """All documents' tokens in sequences of 4096, packed by islands of a grouping genetic algorithm."""
    path = public_tokenizers.path("word_bpe_49k.json")
    cut = tokens.pieces(table(spark, sf_dir, "documents"), path, tokens.CAPACITY)
    return packing.pack(cut, tokens.CAPACITY).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query(
    "op1_warc",
    """
    WITH sized AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
    ), first AS (
        SELECT payload_digest, min(page_id) AS first_id FROM sized WHERE payload_bytes >= 100 GROUP BY 1
    )
    SELECT page_id, payload_bytes, s.payload_digest, CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM sized s LEFT JOIN first f ON s.payload_digest = f.payload_digest
    """,
)
def op1_warc(spark, sf_dir):
    """All pages written as WARC archives and read back: digests and sizes of responses from the payloads read."""
    warc.register(spark)
    folder = work_folder(spark, "warc")
    warc.records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").option("path", folder).save()
    back = spark.read.format("warc").option("path", folder).load().where(F.col("record_type").isin("response", "revisit"))
    response = F.col("record_type") == "response"
    return back.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        F.when(response, F.length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


@query("op3_fingerprints")
def op3_fingerprints(spark, sf_dir):
    """Closed-syncmer fingerprints of every document and of its edited text, with their likeness."""
    return syncmers.compare(table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    """Greedy longest-match token counts of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = wordpiece.token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return counted.select("doc_id", "n_words", "n_tokens")


@query("op8_license_scan")
def op8_license_scan(spark, sf_dir):
    """Licences of every document, with their scores and places."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), joined=True)
    spans = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses.license", ",").alias("licenses"),
        F.round(F.array_max("licenses.score"), 6).alias("best_score"), F.array_join(spans, ",").alias("spans"),
    )


def _clustering_sql(rounds: int = clustering.ROUNDS) -> str:
    """Plain k-means: every vector against every centroid, a round after the other."""
    apart = "CAST(list_sum(list_transform(list_zip(v, c), lambda x: CAST(x[1] - x[2] AS HUGEINT) * (x[1] - x[2]))) AS BIGINT)"
    parts = [
        """
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS n, v AS c FROM kept
            QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= 16
        )"""
    ]
    for i in range(rounds + 1):
        parts.append(
            f""", near{i} AS MATERIALIZED (
            SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(n, {apart} * 16::HUGEINT + n) AS n, min({apart}) AS distance
            FROM kept, c{i} GROUP BY r
        )"""
        )
        if i < rounds:
            parts.append(
                f""", sums{i} AS (SELECT n, pos, sum(v[pos]) AS s, count(*) AS m FROM near{i}, generate_series(1, 64) AS t(pos) GROUP BY 1, 2),
        means{i} AS (SELECT n, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY pos) AS c FROM sums{i} GROUP BY n),
        c{i + 1} AS MATERIALIZED (SELECT n, coalesce(m.c, old.c) AS c FROM c{i} old LEFT JOIN means{i} m USING (n))"""
            )
    last = f"near{rounds}"
    parts.append(
        f"""
        SELECT vec_id, CAST({last}.n AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY {last}.n) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM {last} JOIN c{rounds} USING (n)"""
    )
    return "".join(parts)


@query("op11_clustering", _clustering_sql())
def op11_clustering(spark, sf_dir):
    """Exact k-means of all vectors; Ptolemaic bounds over fixed pivot pairs spare distances."""
    return clustering.summary(table(spark, sf_dir, "embeddings"))


@query(
    "op12_fill_in_middle",
    """
    WITH cut AS (
        SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
               sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
        FROM documents
    ), drawn AS (
        SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (len(w) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(w) + 1) AS b,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                         OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
                    WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM cut
    ), parts AS (
        SELECT doc_id, text, form, CAST(len(w) AS BIGINT) AS n, array_to_string(w[1:least(a, b)], '') AS prefix,
               array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(w[greatest(a, b) + 1:], '') AS suffix
        FROM drawn
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM parts
    """,
)
def op12_fill_in_middle(spark, sf_dir):
    """Every document in its fill-in-middle form, cut at ranks of a skip list, and the text put together from it again."""
    made = middles.transform(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    back = middles.restored(F.col("form"), F.col("output"))
    return made.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )


@query("op13_sharding")
def op13_sharding(spark, sf_dir):
    """All documents in 40 shards of near-equal bytes, the leaves of a k-d tree over their metadata."""
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
