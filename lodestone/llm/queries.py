"""Queries of this subpackage over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licenses, line_dedup, mixing, neardup, ngram_join, packing, pii, suffix_tree, topk, toxicity
from .storage import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_data(_table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"), share=mixing.SHARE)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_neardup, op2_topk_search, op3_license_scan, op4_lm_score, op5_toxicity, op6_line_dedup, op7_pii, op8_ngram_join, op9_mix_sources, op10_pack)}


def oracle_sql() -> dict[str, str]:
    return {
        # every document scored for every query
        "op2_topk_search": """
            WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents),
            len AS (SELECT d.doc_id, count(t.w) AS n FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY 1),
            size AS (SELECT count(*) AS docs, avg(n) AS mean FROM len),
            qt AS (SELECT item_id, w, count(*) AS qn FROM
                   (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM benchmark) GROUP BY 1, 2),
            tf AS (SELECT doc_id, w, count(*) AS tf FROM tok WHERE w IN (SELECT w FROM qt) GROUP BY 1, 2),
            df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
            scored AS (SELECT qt.item_id, tf.doc_id, round(sum(qt.qn * ln(1 + (size.docs - df.df + 0.5) / (df.df + 0.5))
                       * (tf.tf * 2.2) / (tf.tf + 1.2 * (0.25 + 0.75 * len.n / size.mean))), 6) AS score
                       FROM qt JOIN tf USING (w) JOIN df USING (w) JOIN len USING (doc_id), size GROUP BY 1, 2)
            SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
                           FROM scored WHERE score > 0) WHERE rank <= 10""",
        # all pairs of distinct sets of word 3-grams by an inverted index; groups by recursion over the similar ones
        "op8_ngram_join": """
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
            g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS s FROM w WHERE len(ws) > 0),
            c AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM g GROUP BY s),
            f AS (SELECT rep, n, unnest(s) AS gram FROM c),
            p AS (SELECT a.rep AS x, b.rep AS y FROM f a JOIN f b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.5 * (a.n + b.n - count(*))),
            reach(x, y) AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM reach r JOIN p ON r.y = p.x),
            own AS (SELECT c.s, c.rep, least(c.rep, coalesce(min(r.y), c.rep)) AS root FROM c LEFT JOIN reach r ON r.x = c.rep GROUP BY 1, 2),
            links AS (SELECT x, count(*) AS links FROM p GROUP BY 1),
            m AS (SELECT DISTINCT doc_id, rep, root FROM g JOIN own USING (s)),
            often AS (SELECT root, min(doc_id) AS group_id FROM m GROUP BY 1 HAVING count(*) > 1)
            SELECT doc_id, group_id, coalesce(links, 0) AS links FROM m JOIN often USING (root) LEFT JOIN links ON x = rep""",
        # every pair compared; components by recursion over the pairs found
        "op1_embedding_neardup": """
            WITH RECURSIVE c AS (SELECT embedding AS e, min(vec_id) AS rep FROM embeddings GROUP BY 1),
            near AS (SELECT a.rep AS x, b.rep AS y FROM c a JOIN c b ON a.rep <> b.rep AND list_cosine_similarity(a.e, b.e) >= 0.95),
            reach(x, y) AS (SELECT x, y FROM near UNION SELECT r.x, p.y FROM reach r JOIN near p ON r.y = p.x),
            least AS (SELECT x, min(y) AS y FROM reach GROUP BY x), links AS (SELECT x, count(*) AS links FROM near GROUP BY x)
            SELECT e.vec_id, coalesce(least(c.rep, l.y), c.rep) AS cluster_id, coalesce(least(c.rep, l.y), c.rep) = e.vec_id AS keep, coalesce(n.links, 0) AS links
            FROM embeddings e JOIN c ON c.e = e.embedding LEFT JOIN least l ON c.rep = l.x LEFT JOIN links n ON n.x = c.rep""",
    }
