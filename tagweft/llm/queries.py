"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bm25, bpe, leaks, negatives, pieces, pii, quotes, repeats, secrets, selection, simhash, toxicity

MODEL = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"
WORDS = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), model_path())


def op4_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return selection.cross_entropy_difference(table(spark, sf_dir, "documents"), wanted)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op8_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotes.threads(table(spark, sf_dir, "conversations"))
    return found.withColumn("text", F.sha2(F.col("text").cast("binary"), 256)).withColumnRenamed("text", "text_sha256")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bm25.top_k(docs, docs.where("doc_id % 20 = 0"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.statistics(table(spark, sf_dir, "documents"), model_path(BYTES), model_path())


def op12_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), model_path(WORDS))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_secrets, op3_pieces, op4_selection, op5_pii, op6_leaks, op7_repeats, op8_threads, op9_simhash, op10_bm25, op11_alignment, op12_merges, op13_negatives)}
ORACLES: dict[str, str] = {
    "op13_negatives": """
        WITH e AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.rid <> b.rid),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.arid, p.rid ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
            FROM p JOIN s ON p.arid = s.arid AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
        SELECT * FROM n WHERE rank <= 3
    """,
    "op7_repeats": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT rid, s, array_to_string(w[s:s+34], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
        rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
        gone AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(s, s + 35)) AS p FROM win JOIN rep USING (k))),
        word AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid),
        n AS (SELECT rid, count(*) AS c FROM gone GROUP BY rid)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (rid) LEFT JOIN n USING (rid)
    """,
}
