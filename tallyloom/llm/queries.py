"""The queries opN_<name>: each operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, n: int):
    """crc32 of an id as text, modulo n; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")), F.lit(n)), F.lit(0))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import substring_dedup

    found = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold("doc_id", 4) == 2
    known = language.profiles(docs.where(~held))
    out = language.with_language(docs.withColumn("held_out", held), known, "lang_pred", "score", keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import byte_bpe

    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import pages

    return pages.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template", "n_ruled")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import media

    return media.stored_media(table(spark, sf_dir, "documents")).withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import token_store

    return token_store.stored_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import decontaminate

    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = fold("doc_id", 3) == 1
    machine = toxicity.train(docs, labels.where(~held))
    found = toxicity.scored(docs.withColumn("held_out", held), machine, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import secrets

    found = secrets.secrets(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda f: f["kind"] < 3)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("found")).alias("spans"), "n_live", "n_copied", secrets.written(F.col("found"), True).alias("classes"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import centroids

    return centroids.described(*centroids.clusters(table(spark, sf_dir, "embeddings"))).drop("n_distances")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import personal

    found = personal.personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda f: f["kind"] < personal.BASE)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(personal.written(base), 256).alias("base_sha256"), personal.written(F.col("found")).alias("spans"), "n_added", personal.written(F.col("found"), True).alias("scores"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import filter_audit

    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_language_id,
        op3_byte_bpe,
        op4_page_text,
        op5_media,
        op6_token_store,
        op7_decontamination,
        op8_simhash,
        op9_toxicity,
        op10_secret_scan,
        op11_centroids,
        op12_personal_data,
        op13_filter_audit,
    )
}


def centroids_sql(rounds: int = 10) -> str:
    """All distances in every round, each round a few common tables."""
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, x FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8)",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS MATERIALIZED (SELECT v.vec_id, v.x, c, CAST(list_sum(list_transform(v.x, lambda a, j: (a - y.x[j]) * (a - y.x[j]))) AS BIGINT) AS d FROM v, c{i} y)")
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, x, c, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS nr FROM d{i}) WHERE nr = 1)")
        if i < rounds:
            parts.append(f"s{i} AS MATERIALIZED (SELECT c, j, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, unnest(range(1, 65)) AS j FROM a{i}) GROUP BY c, j)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT y.c, coalesce(m.x, y.x) AS x FROM c{i} y LEFT JOIN (SELECT c, list((s - (s % n + n) % n) // n ORDER BY j) AS x FROM s{i} GROUP BY c) m ON y.c = m.c)")
    return f"""WITH {", ".join(parts)}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(y.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} y ON a.c = y.c"""


#: The queries that SQL can express. Windows are compared as strings here, without anchors, hashes or an automaton.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nr FROM win) WHERE nr > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, range(20) r(k)),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, width, array_to_string(ws[i : i + width - 1], ' ') AS s FROM (SELECT item_id, ws, least(10, len(ws)) AS width, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, i, width, array_to_string(ws[i : i + width - 1], ' ') AS s FROM (SELECT doc_id, ws, width, unnest(range(1, len(ws) - width + 2)) AS i FROM d, (SELECT DISTINCT width FROM iw) WHERE len(ws) >= width)),
hit AS (SELECT doc_id, i, width, item_id FROM dw JOIN iw USING (width, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op11_centroids": centroids_sql(),
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT doc_id, part, CAST(len(ws) < 100 AS INT) AS a, CAST(100 * len(list_distinct(ws)) < 80 * len(ws) AS INT) AS b, CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS INT) AS c,
  CAST(regexp_matches(t, '[#$%&*|]') AS INT) AS s, CAST(doc_id > min(doc_id) OVER (PARTITION BY t) AS INT) AS e FROM d),
m AS (SELECT part, [a, b, c, s, e] AS fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS bad FROM f LEFT JOIN labels USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [p.i, q.i, r.i, s.i, t.i] AS path FROM l p, l q, l r, l s, l t WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
st AS (SELECT array_to_string(list_transform(path, lambda x: chr(CAST(64 + x AS INTEGER))), '') AS filter_order, i AS step, path[i] AS f, path[1 : i - 1] AS earlier FROM o, l),
x AS (SELECT part, filter_order, step, f, n, good, bad, fails[f] = 1 AS hit, len(list_filter(earlier, lambda p: fails[p] = 1)) > 0 AS gone, list_sum(fails) AS total FROM m, st),
r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant,
  coalesce(sum(n) FILTER (hit AND total = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(bad) FILTER (hit AND NOT gone), 0) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r""",
}
