"""Registered queries of this subpackage: one per operator, over whole
tables, and the DuckDB statement of those that SQL can express."""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.session import ensure_checkpoint_dir, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return add


@register("op6_mixing")
def op6_mixing(spark, sf_dir):
    from quarry.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


@register("op9_sharding")
def op9_sharding(spark, sf_dir):
    from quarry.llm.sharding import shard_digest

    return shard_digest(table(spark, sf_dir, "documents"))


@register("op3_warc", """
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
    FROM (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
                 CASE WHEN strlen(html) >= 100 AND page_id > min(page_id) OVER same
                      THEN min(page_id) OVER same END AS refers_to
          FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)
          WINDOW same AS (PARTITION BY html))""")
def op3_warc(spark, sf_dir):
    from quarry.llm.warc import archive_pages

    return archive_pages(spark, table(spark, sf_dir, "pages")).drop("url")


# The fixed rules of the url query: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@register("op10_urls")
def op10_urls(spark, sf_dir):
    from quarry.llm.urls import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES)


@register("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    from pyspark.sql import functions as F
    from quarry.llm.toxicity import fold, toxicity, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model, ["doc_id"]).select(
        "doc_id", (fold("doc_id") == 0).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= 0.5).cast("int").alias("predicted"))


@register("op5_quality")
def op5_quality(spark, sf_dir):
    from quarry.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    """A public vocabulary file installed beside Python's libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op4_tokens")
def op4_tokens(spark, sf_dir):
    from quarry.llm.tokens import load_sentencepiece, token_counts

    return token_counts(table(spark, sf_dir, "documents"), *load_sentencepiece(vocabulary_path()), ["doc_id"])


@register("op2_embeddings", """
    WITH RECURSIVE v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.95),
    reach(id, other) AS (
        SELECT vec_id, vec_id FROM embeddings
        UNION
        SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
    component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
    n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN component ON component.id = vec_id LEFT JOIN n ON n.a = vec_id""")
def op2_embeddings(spark, sf_dir):
    from quarry.llm.embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@register("op7_jaccard", r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents),
    sets AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)),
    size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    links AS (
        SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
                          FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
        JOIN size p1 ON p1.doc_id = a JOIN size p2 ON p2.doc_id = b WHERE 100 * c >= 75 * (p1.n + p2.n - c)),
    reach(id, other) AS (
        SELECT doc_id, doc_id FROM documents
        UNION
        SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
    FROM documents JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) ON id = doc_id LEFT JOIN size USING (doc_id)""")
def op7_jaccard(spark, sf_dir):
    from quarry.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


@register("op1_decontaminate")
def op1_decontaminate(spark, sf_dir):
    from quarry.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


PHRASES_SQL = r"""
    WITH pieces AS (
        SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece
        FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
    words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
    runs AS (
        SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
        FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
              FROM words, (VALUES (1), (2), (3)) sizes(k) WHERE len(w) >= k)),
    f AS (SELECT lang, k, phrase, count(*) AS c FROM runs GROUP BY ALL),
    total AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
    known AS MATERIALIZED (SELECT lang, k, phrase, c FROM f WHERE c >= 10),
    candidates AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM known WHERE k > 1),
    cuts AS (
        SELECT x.lang, x.k, x.phrase, x.a, x.cut, p.c AS l, q.c AS r,
               (1000000::HUGEINT * x.a * x.a // (p.c::HUGEINT * q.c))::BIGINT AS score
        FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) x
        JOIN known p ON p.lang = x.lang AND p.phrase = array_to_string(x.w[1:x.cut], ' ')
        JOIN known q ON q.lang = x.lang AND q.phrase = array_to_string(x.w[x.cut + 1:x.k], ' ')),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    inner_ AS (
        SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS longer
        FROM (SELECT lang, w, a, unnest([1, 2]) AS i FROM candidates WHERE k = 3) GROUP BY ALL),
    kept AS (
        SELECT b.* FROM best b LEFT JOIN inner_ USING (lang, phrase)
        WHERE b.k = 3 OR longer IS NULL OR 100 * longer < 50 * b.a),
    placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN total USING (lang) WHERE rank <= 2000"""


@register("op12_phrases", PHRASES_SQL)
def op12_phrases(spark, sf_dir):
    from quarry.llm.phrases import phrases

    return phrases(table(spark, sf_dir, "documents"))


@register("op11_hard_negatives", """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
               CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY rank <= 5""")
def op11_hard_negatives(spark, sf_dir):
    from quarry.llm.negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))


@register("op13_substrings", r"""
    WITH docs AS (
        SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents),
    windows AS (
        SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20)),
    again AS (
        SELECT doc_id, i FROM windows
        QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
    gone AS (SELECT doc_id, list(DISTINCT p) AS gone
             FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM again) GROUP BY doc_id),
    words AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM docs),
    left_ AS (
        SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS kept, count(*) AS n
        FROM words x WHERE NOT EXISTS (
            SELECT 1 FROM (SELECT doc_id, unnest(gone) AS p FROM gone) g WHERE g.doc_id = x.doc_id AND g.p = x.p)
        GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM docs LEFT JOIN left_ USING (doc_id)""")
def op13_substrings(spark, sf_dir):
    from quarry.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))
