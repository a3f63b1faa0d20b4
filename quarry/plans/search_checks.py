"""Vectors, search, catalogue matching and key lookups."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import snippet
from quarry.functions.vectors import l2_normalise
from quarry.operators.embed import hashed_vectors, sparse_long
from quarry.operators.lookup import first_per_key, list_all, lookup, unmatched
from quarry.operators.chunks import char_chunks
from quarry.operators.index import build_index, index_search, store_index
from quarry.operators.retrieve import catalogue_vectors, keep_min_score, match_catalogue, non_blank, retrieve
from quarry.operators.search import search
from quarry.plans import callables
from quarry.plans import sql as S
from quarry.plans.corpus_checks import (DOC_CHUNKS_SQL, DOC_OVERLAP, DOC_TOKENS, SECTION_OVERLAP, SECTION_TOKENS,
                                        conversation_statutes)
from quarry.plans.ingest import build_vectors, corpus_chunks, load_vectors
from quarry.plans.registry import register, table
from quarry.session import materialize, scratch_path
from quarry.sources.tables import create_database, manifest, read_csv_strings, write_bucketed, write_csv

KNN_K = 5
KNN_MIN = 0.40


def zero_signed(c):
    """-0.0 -> 0.0 so both engines print the same value."""
    return F.when(c == 0, F.lit(0.0)).otherwise(c)


@register("hashed_vectors", f"""
SELECT doc_id, bucket, round(weight, 6) AS weight
FROM {S.hashed_long('documents', 'doc_id', 'text')}
""")
def hashed_vectors_check(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    v = hashed_vectors(d, "text", keep=["doc_id"])
    return sparse_long(v, ["doc_id"]).withColumn("weight", F.round("weight", 6))


@register("l2_normalise", """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (vec_id % 7)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM s),
e AS (SELECT vec_id, v, norm, unnest(range(len(v))) AS pos FROM n)
SELECT vec_id, CAST(pos AS BIGINT) AS pos,
       CASE WHEN v[pos + 1] = 0 THEN 0.0
            ELSE round(v[pos + 1] / CASE WHEN norm = 0 THEN 1 ELSE norm END, 6) END AS value
FROM e
""")
def l2_normalise_check(spark, sf):
    e = table(spark, sf, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7))
    return (e.select("vec_id", F.posexplode(l2_normalise(scaled)).alias("pos", "value"))
            .select("vec_id", F.col("pos").cast("long").alias("pos"),
                    zero_signed(F.round("value", 6)).alias("value")))


@register("vector_manifest", """
SELECT CAST(max(len(embedding)) AS BIGINT) AS dim, CAST(min(len(embedding)) AS BIGINT) AS min_dim,
       count(*) AS ntotal, '["vec_id", "label"]' AS metadata_columns
FROM embeddings
""")
def vector_manifest(spark, sf):
    return manifest(table(spark, sf, "embeddings"), "embedding")


def dense_knn(spark, sf, **kw) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return search(e, e, KNN_K, kind="dense", question_id="vec_id", corpus_id="vec_id",
                  exclude_self=True, **kw)


_KNN_SQL = """
SELECT query_id, CAST(rk AS BIGINT) AS rank, hit_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS hit_id,
         round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, c.vec_id) AS rk
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id
  QUALIFY rk <= 5
)
"""


@register("knn_dense", _KNN_SQL)
def knn_dense(spark, sf):
    return dense_knn(spark, sf).withColumn("rank", F.col("rank").cast("long"))


@register("knn_dense_blocked", _KNN_SQL)
def knn_dense_blocked(spark, sf):
    """The same search with small question blocks, which meet the corpus in a grid."""
    return dense_knn(spark, sf, block_bytes=1 << 16).withColumn("rank", F.col("rank").cast("long"))


@register("retrieve_min_score", f"""
SELECT * FROM ({_KNN_SQL}) WHERE score >= {KNN_MIN} OR rank = 1
""")
def retrieve_min_score(spark, sf):
    return keep_min_score(dense_knn(spark, sf), KNN_K, KNN_MIN).withColumn(
        "rank", F.col("rank").cast("long"))


# Text retrieval: benchmark items against chunks of documents.
TEXT_K, TEXT_MIN = 5, 0.55


def passages(spark, sf) -> DataFrame:
    """Chunks of documents with their source as title, carried through the
    chunking (no join back to the documents)."""
    d = table(spark, sf, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("section_id"), F.col("source").alias("title"), "text")
    return char_chunks(d, DOC_TOKENS, DOC_OVERLAP, keep=["doc_id", "section_id", "title"])


def text_hits(spark, sf, attach=None, **kw) -> DataFrame:
    q = table(spark, sf, "benchmark").select(F.col("item_id"), F.col("text").alias("question"))
    return retrieve(q, passages(spark, sf), TEXT_K, TEXT_MIN, question_id="item_id",
                    question_text="question", passage_id="chunk_id", attach=attach, **kw)


TEXT_HITS_SQL = f"""(
  SELECT item_id AS query_id, chunk_id AS hit_id, score, CAST(rk AS BIGINT) AS rank
  FROM {S.sparse_top_k(S.hashed_long(f"(SELECT * FROM benchmark WHERE {S.strip("coalesce(text, '')")} <> '')",
                                     'item_id', 'text'),
                       S.hashed_long(DOC_CHUNKS_SQL, 'chunk_id', 'text'), 'item_id', 'chunk_id', TEXT_K)}
  WHERE score >= {TEXT_MIN} OR rk = 1
)"""


@register("retrieve_text", f"""
SELECT h.query_id AS item_id, h.rank, h.hit_id AS chunk_id, c.doc_id, h.score,
       translate(substring(c.text, 1, 280), chr(10), ' ') AS snippet
FROM {TEXT_HITS_SQL} h JOIN {DOC_CHUNKS_SQL} c ON c.chunk_id = h.hit_id
""")
def retrieve_text(spark, sf):
    hits = text_hits(spark, sf, attach=["doc_id", "text"])
    return hits.select(F.col("query_id").alias("item_id"), F.col("rank").cast("long").alias("rank"),
                       F.col("hit_id").alias("chunk_id"), "doc_id", "score",
                       snippet("text").alias("snippet"))


@register("retrieve_text_blocked", f"""
SELECT h.query_id AS item_id, h.rank, h.hit_id AS chunk_id, c.doc_id, h.score
FROM {TEXT_HITS_SQL} h JOIN {DOC_CHUNKS_SQL} c ON c.chunk_id = h.hit_id
""")
def retrieve_text_blocked(spark, sf):
    """Text retrieval with small question blocks, which meet the corpus in a grid."""
    hits = text_hits(spark, sf, attach=["doc_id"], block_bytes=1 << 12)
    return hits.select(F.col("query_id").alias("item_id"), F.col("rank").cast("long").alias("rank"),
                       F.col("hit_id").alias("chunk_id"), "doc_id", "score")


@register("retrieve_bucketed", f"""
SELECT h.query_id AS item_id, h.rank, h.hit_id AS chunk_id, c.doc_id, h.score,
       translate(substring(c.text, 1, 280), chr(10), ' ') AS snippet
FROM {TEXT_HITS_SQL} h JOIN {DOC_CHUNKS_SQL} c ON c.chunk_id = h.hit_id
""")
def retrieve_bucketed(spark, sf):
    """Text retrieval over a stored passage table that is bucketed by the
    passage's id: its rows stay in their buckets when hits meet them."""
    base = scratch_path(spark, "bucketed")
    create_database(spark, "quarry_store", f"{base}/warehouse")
    name = f"quarry_store.passages_{base.rsplit('-', 1)[-1]}"
    write_bucketed(passages(spark, sf), name, "chunk_id", int(spark.conf.get("spark.sql.shuffle.partitions")), f"{base}/table")
    stored = spark.table(name)
    q = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"))
    hits = retrieve(q, stored, TEXT_K, TEXT_MIN, question_id="item_id", question_text="question",
                    passage_id="chunk_id", attach=["doc_id", "text"])
    return hits.select(F.col("query_id").alias("item_id"), F.col("rank").cast("long").alias("rank"),
                       F.col("hit_id").alias("chunk_id"), "doc_id", "score", snippet("text").alias("snippet"))


@register("retrieve_text_index", f"""
SELECT h.query_id AS item_id, h.rank, h.hit_id AS chunk_id, h.score FROM {TEXT_HITS_SQL} h
""")
def retrieve_text_index(spark, sf):
    """Text retrieval through a stored index that skips passages out of reach."""
    index = store_index(build_index(hashed_vectors(passages(spark, sf), "text", keep=["chunk_id"]), "chunk_id"))
    q = non_blank(table(spark, sf, "benchmark").select("item_id", "text"), "text")
    hits = index_search(hashed_vectors(q, "text", keep=["item_id"]), index, TEXT_K, question_id="item_id")
    return keep_min_score(hits, TEXT_K, TEXT_MIN).select(
        F.col("query_id").alias("item_id"), F.col("rank").cast("long").alias("rank"),
        F.col("hit_id").alias("chunk_id"), "score")


@register("knn_sparse_all", f"""
WITH p AS {DOC_CHUNKS_SQL}, v AS {S.hashed_long('p', 'chunk_id', 'text')}
SELECT query_id, hit_id, score, CAST(rk AS BIGINT) AS rank
FROM (SELECT q.chunk_id AS query_id, m.hit_id, m.score, m.rk
      FROM (SELECT DISTINCT chunk_id FROM p WHERE chunk_index = 0) q
      JOIN (SELECT a.chunk_id AS query_id, b.chunk_id AS hit_id, round(sum(a.weight * b.weight), 6) AS score,
                   row_number() OVER (PARTITION BY a.chunk_id ORDER BY round(sum(a.weight * b.weight), 6) DESC,
                                      b.chunk_id) AS rk
            FROM v a JOIN v b ON a.bucket = b.bucket
            WHERE a.chunk_id IN (SELECT chunk_id FROM p WHERE chunk_index = 0)
            GROUP BY a.chunk_id, b.chunk_id) m ON m.query_id = q.chunk_id)
WHERE rk <= 3
""")
def knn_sparse_all(spark, sf):
    """Every document's first chunk as a question against all chunks, in a
    grid of question groups and index segments."""
    vectors = materialize(hashed_vectors(passages(spark, sf).select("chunk_id", "chunk_index", "text"), "text",
                                         keep=["chunk_id", "chunk_index"]), {"compression": "zstd"})
    q = vectors.filter((F.col("chunk_index") == 0) & (F.size("buckets") > 0))
    hits = index_search(q, store_index(build_index(vectors, "chunk_id", 2048)), 3, question_id="chunk_id",
                        block_bytes=1 << 15)
    return hits.select("query_id", "hit_id", "score", F.col("rank").cast("long").alias("rank"))


# Sections of many documents: section and chunk ids repeat, passage ids do not.
SECTION_K, SECTION_MIN = 5, 0.4
SECTION_PASSAGES_SQL = f"""(
  SELECT *, CAST(doc_id AS VARCHAR) || '#' || CAST(section_ord AS VARCHAR) || '.' || CAST(chunk_index AS VARCHAR)
            AS passage_id
  FROM {S.char_chunks(S.section_rows(), "section_id", "text", SECTION_TOKENS, SECTION_OVERLAP,
                      extra="doc_id, section_ord, title")}
)"""


@register("retrieve_sections", f"""
WITH p AS {SECTION_PASSAGES_SQL},
q AS (SELECT item_id, text FROM benchmark WHERE {S.strip("coalesce(text, '')")} <> ''),
m AS (SELECT item_id, passage_id, score, rk
      FROM {S.sparse_top_k(S.hashed_long('q', 'item_id', 'text'), S.hashed_long('p', 'passage_id', 'text'),
                           'item_id', 'passage_id', SECTION_K)}),
h AS (SELECT * FROM m WHERE score >= {SECTION_MIN} OR rk = 1
      UNION ALL  -- a question that shares no term keeps the smallest passage, with score 0
      SELECT item_id, (SELECT min(passage_id) FROM p), 0.0, 1 FROM q WHERE item_id NOT IN (SELECT item_id FROM m))
SELECT h.item_id, CAST(h.rk AS BIGINT) AS rank, h.passage_id, h.score, p.doc_id, p.section_id, p.title, p.chunk_id
FROM h JOIN p ON p.passage_id = h.passage_id
""")
def retrieve_sections(spark, sf):
    chunks = corpus_chunks(conversation_statutes(spark, sf), SECTION_TOKENS, SECTION_OVERLAP)
    q = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"))
    hits = retrieve(q, chunks, SECTION_K, SECTION_MIN, question_id="item_id",
                    attach=["doc_id", "section_id", "title", "chunk_id"])
    return hits.select(F.col("query_id").alias("item_id"), F.col("rank").cast("long").alias("rank"),
                       F.col("hit_id").alias("passage_id"), "score", "doc_id", "section_id", "title", "chunk_id")


# Dense retrieval: a stand-in model (letter counts) that SQL can restate.
def letters_sql(src: str, id_col: str, text_col: str) -> str:
    counts = ", ".join(f"length(t) - length(replace(t, '{c}', ''))" for c in callables.LETTERS)
    return f"""(
      SELECT {id_col}, list_transform(v, lambda x: CAST(CAST(
               x / CASE WHEN n = 0 THEN 1 ELSE n END AS FLOAT) AS DOUBLE)) AS vec
      FROM (SELECT {id_col}, v, sqrt(list_sum(list_transform(v, lambda x: CAST(x * x AS DOUBLE)))) AS n
            FROM (SELECT {id_col}, [{counts}] AS v FROM (SELECT {id_col}, {text_col} AS t FROM {src}))))"""


def dense_top_k_sql(q: str, c: str, qid: str, cid: str, k: int) -> str:
    return f"""(SELECT q.{qid}, c.{cid}, round(list_inner_product(q.vec, c.vec), 6) AS score,
                       row_number() OVER (PARTITION BY q.{qid} ORDER BY score DESC, c.{cid}) AS rk
                FROM {q} q CROSS JOIN {c} c QUALIFY rk <= {k})"""


@register("retrieve_dense_text", f"""
WITH q AS (SELECT item_id, text FROM benchmark WHERE {S.strip("coalesce(text, '')")} <> ''),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT * FROM {dense_top_k_sql(letters_sql('q', 'item_id', 'text'), letters_sql('d', 'doc_id', 't'),
                                     'item_id', 'doc_id', 5)} WHERE score >= 0.99 OR rk = 1)
SELECT h.item_id, CAST(h.rk AS BIGINT) AS rank, h.doc_id, h.score, documents.source
FROM h JOIN documents ON documents.doc_id = h.doc_id
""")
def retrieve_dense_text(spark, sf):
    """A model's vectors of whole documents, stored once, and its search."""
    docs = table(spark, sf, "documents")
    base = scratch_path(spark, "dense")
    build_vectors(docs, base, id_col="doc_id", encoder_factory=callables.letter_encoder)
    q = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"))
    hits = retrieve(q, docs, 5, 0.99, question_id="item_id", passage_id="doc_id", attach=["source"],
                    vectors=load_vectors(spark, base)[0], encoder_factory=callables.letter_encoder)
    return hits.select(F.col("query_id").alias("item_id"), F.col("rank").cast("long").alias("rank"),
                       F.col("hit_id").alias("doc_id"), "score", "source")


@register("catalogue_dense", f"""
WITH cat AS (SELECT p_partkey, coalesce(p_name, '') || '. ' || coalesce(p_type, '') || '. Eligibility: '
                    || coalesce(p_brand, '') AS t FROM part),
q AS (SELECT item_id, text FROM benchmark WHERE {S.strip("coalesce(text, '')")} <> ''),
h AS (SELECT * FROM {dense_top_k_sql(letters_sql('q', 'item_id', 'text'), letters_sql('cat', 'p_partkey', 't'),
                                     'item_id', 'p_partkey', 3)} WHERE score >= 0.5)
SELECT h.item_id AS query_id, CAST(h.rk AS BIGINT) AS rank, h.p_partkey AS hit_id, h.score, part.p_name
FROM h JOIN part ON part.p_partkey = h.p_partkey
""")
def catalogue_dense(spark, sf):
    """A catalogue encoded once, its vectors stored and passed to the match."""
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    names = dict(catalogue_id="p_partkey", name="p_name", description="p_type", eligibility="p_brand")
    stored = materialize(catalogue_vectors(part, encoder_factory=callables.letter_encoder, **names))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    m = match_catalogue(q, part, 3, 0.5, vectors=stored, encoder_factory=callables.letter_encoder, **names)
    return m.select("query_id", F.col("rank").cast("long").alias("rank"), "hit_id", "score", "p_name")


# Catalogue: parts as catalogue rows, every part's name as a question.
@register("catalogue_match", f"""
WITH cat AS (SELECT p_partkey, coalesce(p_name, '') || '. ' || coalesce(p_type, '') || '. Eligibility: '
                    || coalesce(p_brand, '') AS t FROM part),
q AS (SELECT p_partkey AS query_id, p_name AS t FROM part WHERE {S.strip("coalesce(p_name, '')")} <> ''),
r AS (SELECT * FROM {S.sparse_top_k(S.hashed_long('q', 'query_id', 't'), S.hashed_long('cat', 'p_partkey', 't'),
                                     'query_id', 'p_partkey', 3)} WHERE score >= 0.25)
SELECT r.query_id, CAST(r.rk AS BIGINT) AS rank, r.p_partkey AS hit_id, r.score, p.p_name, p.p_brand
FROM r JOIN part p ON p.p_partkey = r.p_partkey
""")
def catalogue_match(spark, sf):
    part = table(spark, sf, "part")
    qs = part.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("question"))
    m = match_catalogue(qs, part.select("p_partkey", "p_name", "p_type", "p_brand").fillna(""),
                        3, 0.25, catalogue_id="p_partkey", name="p_name", description="p_type",
                        eligibility="p_brand")
    return m.select("query_id", F.col("rank").cast("long").alias("rank"), "hit_id", "score",
                    "p_name", "p_brand")


@register("retrieve_whole_corpus", f"""
WITH q AS (SELECT p_partkey, p_name FROM part WHERE {S.strip("coalesce(p_name, '')")} <> '')
SELECT h.p_partkey, CAST(h.rk AS BIGINT) AS rank, h.r_regionkey, h.score, region.r_name
FROM {dense_top_k_sql(letters_sql('q', 'p_partkey', 'p_name'), letters_sql('region', 'r_regionkey', 'r_name'),
                      'p_partkey', 'r_regionkey', 50)} h
JOIN region ON region.r_regionkey = h.r_regionkey
""")
def retrieve_whole_corpus(spark, sf):
    """More hits are asked for than the corpus has passages: every question
    gets each passage once and no empty places."""
    q = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("question"))
    hits = retrieve(q, table(spark, sf, "region"), 50, -1.0, question_id="p_partkey", passage_id="r_regionkey",
                    passage_text="r_name", attach=["r_name"], encoder_factory=callables.letter_encoder)
    return hits.select(F.col("query_id").alias("p_partkey"), F.col("rank").cast("long").alias("rank"),
                       F.col("hit_id").alias("r_regionkey"), "score", "r_name")


# Lookups through normalised keys.
def _norm_sql(x: str) -> str:
    return f"lower(coalesce(nullif(ltrim({S.strip(x)}, '0'), ''), '0'))"


@register("key_lookup", f"""
WITH m AS (SELECT * FROM (SELECT c_custkey, c_name, c_nationkey, {_norm_sql('CAST(c_custkey AS VARCHAR)')} AS k,
                                 row_number() OVER (PARTITION BY k ORDER BY c_custkey) AS rn FROM customer)
           WHERE rn = 1),
l AS (SELECT c_custkey AS query_id, regexp_extract(c_name, '[0-9]+$') AS lookup_key FROM customer)
SELECT l.query_id, l.lookup_key, m.c_custkey, m.c_name, m.c_nationkey
FROM l JOIN m ON {_norm_sql('l.lookup_key')} = m.k
""")
def key_lookup(spark, sf):
    c = table(spark, sf, "customer")
    keys = c.select(F.col("c_custkey").alias("query_id"),
                    F.regexp_extract("c_name", r"[0-9]+$", 0).alias("lookup_key"))
    mapping = first_per_key(c.select("c_custkey", "c_name", "c_nationkey"),
                            F.col("c_custkey").cast("string"), order_col="c_custkey")
    return lookup(keys, "lookup_key", mapping).select(
        "query_id", "lookup_key", "c_custkey", "c_name", "c_nationkey")


KEY_RECORDS = [(1, " 0007 "), (2, "12"), (3, "0"), (4, "7A"), (5, ""), (6, None), (7, "7")]
_KEY_VALUES = ", ".join(f"({i}, {'NULL' if k is None else repr(k)})" for i, k in KEY_RECORDS)


@register("record_lookup", f"""
WITH l AS (SELECT CAST(i AS BIGINT) AS query_id, k AS lookup_key FROM (VALUES {_KEY_VALUES}) t(i, k)),
o AS (SELECT {_norm_sql('CAST(o_custkey AS VARCHAR)')} AS k, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1)
SELECT l.query_id, l.lookup_key, CAST(o.o_orderkey AS BIGINT) AS o_orderkey
FROM l JOIN o ON {_norm_sql('l.lookup_key')} = o.k WHERE l.lookup_key IS NOT NULL
""")
def record_lookup(spark, sf):
    """Records held by the caller, looked up in a table: each customer's
    first order.  A null key finds nothing."""
    keys = spark.createDataFrame(KEY_RECORDS, "query_id long, lookup_key string")
    mapping = first_per_key(table(spark, sf, "orders").select("o_orderkey", "o_custkey"),
                            F.col("o_custkey").cast("string"), order_col="o_orderkey")
    return lookup(keys, "lookup_key", mapping).select(
        "query_id", "lookup_key", F.col("o_orderkey").cast("long").alias("o_orderkey"))


@register("clause_lookup_csv", """
WITH m AS (SELECT * FROM (
  SELECT substr(o_orderdate_key, 1, 6) AS k, o_orderkey, row_number() OVER (
           PARTITION BY substr(o_orderdate_key, 1, 6) ORDER BY part, o_orderkey) AS rn
  FROM (SELECT o_orderkey, CAST(o_custkey % 500 AS VARCHAR) AS o_orderdate_key, o_orderkey % 3 AS part FROM orders))
  WHERE rn = 1)
SELECT c.c_custkey AS query_id, CAST(m.o_orderkey AS BIGINT) AS o_orderkey
FROM customer c JOIN m ON m.k = CAST(c.c_custkey AS VARCHAR)
""")
def clause_lookup_csv(spark, sf):
    """First row in file order wins: CSV parts in three folders, rows of a
    part in key order, looked up by key."""
    o = table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 3).alias("part"), "o_orderkey", (F.col("o_custkey") % 500).cast("string").alias("key"))
    base = scratch_path(spark, "clauses")
    for part in range(3):
        write_csv(o.filter(F.col("part") == part).select("key", "o_orderkey").repartitionByRange(4, "o_orderkey")
                  .sortWithinPartitions("o_orderkey"), f"{base}/{part}")
    rows = read_csv_strings(spark, f"{base}/*", ["key", "o_orderkey"], ordinal="ord")
    mapping = first_per_key(rows, F.col("key"), "ord")
    keys = table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"),
                                               F.col("c_custkey").cast("string").alias("lookup_key"))
    return lookup(keys, "lookup_key", mapping).select("query_id", F.col("o_orderkey").cast("long").alias("o_orderkey"))


@register("key_unmatched", """
SELECT DISTINCT CAST(doc_id AS VARCHAR) AS key FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def key_unmatched(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"))
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    mapping = first_per_key(labels, F.col("doc_id").cast("string"), order_col="doc_id")
    return unmatched(docs, "key", mapping)


@register("mapping_list", """
SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_nationkey
""")
def mapping_list(spark, sf):
    return list_all(table(spark, sf, "nation"), ["n_nationkey", "n_name", "n_regionkey"], "n_nationkey")


@register("table_head", """
SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier ORDER BY s_suppkey LIMIT 10
""")
def table_head(spark, sf):
    return list_all(table(spark, sf, "supplier"), ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
                    "s_suppkey", limit=10)
