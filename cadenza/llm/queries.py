"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, gif, infill, minhash, packing, pii, quality, seekable, suffix, toxicity, vectors, whitening

#: The key of the registered query; real runs pass their own secret.
PII_KEY = "registered-query"


def vocabulary(name: str) -> str:
    """A file of the public tokenizers; tokenizer paths are parameters of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), words=4, num=80, den=100)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), digest=True)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.toxicity(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.93)


def op5_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, labels(spark, sf_dir).where(~quality.held_out()))
    return quality.quality(docs, model, threshold=0.3).select("doc_id", F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeated_spans(documents(spark, sf_dir), length=100)
    removed = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seekable.token_files(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(documents(spark, sf_dir), PII_KEY, count="n_entities").select("doc_id", "text", "n_entities")


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.stored(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op11_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)
    ids = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_relational_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(documents(spark, sf_dir), seed=1, plain=10, spm=20)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=32)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_minhash_dedup, op2_byte_bpe, op3_toxicity_chain, op4_vector_dedup, op5_quality_compression, op6_suffix_array_dedup, op7_token_files, op8_pii_surrogates, op9_gif_media, op10_best_fit_packing, op11_fm_decontamination, op12_relational_infill, op13_lanczos_whitening)
}
#: Links within (x, y) become each row's smallest reachable id; `links` holds both directions.
_REACH = """reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)"""

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3]) END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT c.x, c.y FROM common c JOIN sizes a ON a.doc_id = c.x JOIN sizes b ON b.doc_id = c.y WHERE 100 * c.n >= 80 * (a.n + b.n - c.n)),
{_REACH}
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.y, d.doc_id)) AS component_id, d.doc_id <= coalesce(l.y, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l ON l.x = d.doc_id""",
    "op4_vector_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0 AND len(list_filter(embedding, lambda z: z <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.93),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x),
{_REACH}
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.y, e.vec_id)) AS component_id, e.vec_id <= coalesce(l.y, e.vec_id) AS kept
FROM embeddings e LEFT JOIN counts c ON c.x = e.vec_id LEFT JOIN least l ON l.x = e.vec_id""",
    "op6_suffix_array_dedup": """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
-- windows are cut from slices of 500 starts, so that no long text is walked for each of them
slices AS (SELECT doc_id, k, substring(h, 1000 * k + 1, 1198) AS h FROM (SELECT doc_id, h, unnest(range(0, n // 500 + 1)) AS k FROM h WHERE n >= 100)),
windows AS (SELECT doc_id, 500 * k + j AS p, substring(h, 2 * j + 1, 200) AS s FROM (SELECT doc_id, k, h, unnest(range(0, 500)) AS j FROM slices) WHERE length(h) >= 2 * j + 200),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM windows) WHERE r > 1),
gaps AS (SELECT doc_id, p, p > lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) + 100 AS fresh FROM later),
runs AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM gaps),
spans AS (SELECT doc_id, run, min(p) AS s, max(p) + 100 AS e FROM runs GROUP BY doc_id, run),
between_ AS (SELECT h.doc_id, h.h, coalesce(x.s, h.n) AS upto, x.e FROM h LEFT JOIN spans x USING (doc_id) UNION ALL SELECT h.doc_id, h.h, h.n, NULL FROM h WHERE doc_id IN (SELECT doc_id FROM spans)),
pieces AS (SELECT doc_id, upto, substring(h, (2 * b + 1)::BIGINT, (2 * (upto - b))::BIGINT) AS t FROM (SELECT doc_id, h, upto, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY upto, e NULLS LAST), 0) AS b FROM between_)),
kept AS (SELECT doc_id, sha256(unhex(string_agg(t, '' ORDER BY upto))) AS k FROM pieces GROUP BY doc_id),
removed AS (SELECT doc_id, sum(e - s)::BIGINT AS n, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT h.doc_id, h.n AS n_bytes, coalesce(r.n, 0) AS n_removed, coalesce(r.spans, 0)::BIGINT AS n_spans, k.k AS kept_sha256
FROM h JOIN kept k USING (doc_id) LEFT JOIN removed r USING (doc_id)""",
    "op11_fm_decontamination": """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM items),
places AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN sizes ON len(w) >= n)),
found AS (SELECT p.doc_id, p.i, p.n, items.item_id FROM places p JOIN items ON p.s = items.s AND p.n = items.n),
hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(named.ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op12_relational_infill": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT *, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(text, 1, lo) AS prefix, substring(text, lo + 1, hi - lo) AS middle, substring(text, hi + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}
