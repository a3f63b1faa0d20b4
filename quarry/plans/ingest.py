"""Composite flows: ingestion (Q-1), vector-set build (Q-2), corpus profile
(Q-8).  Each is a chain of the operators with one write at the end; no
document passes through the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.chunks import char_chunks, chunk_counts
from quarry.functions.vectors import DEFAULT_BUCKETS
from quarry.operators.embed import build_vector_set
from quarry.operators.workers import factory_key
from quarry.operators.sections import split_sections
from quarry.sources import tables as TB
from quarry.session import materialize
from quarry.sources.documents import prefer_paged, read_text_files, split_documents

# Defaults of the reference (tokens per chunk, overlap).
CHUNK_TOKENS = 512
CHUNK_OVERLAP = 64


def corpus_chunks(texts: DataFrame, chunk_tokens: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP,
                  key: str = "doc_id") -> DataFrame:
    """Texts (``key, text``) -> sections -> chunks with the section title
    carried along: ``key, section_ord, section_id, title, chunk_id,
    chunk_index, text, passage_id``.  Section ids repeat across documents and
    inside one; ``passage_id`` (document, place of the section, chunk) is the
    key of a chunk."""
    sections = split_sections(texts, "text", keys=(key,))
    chunks = char_chunks(sections, chunk_tokens, overlap, keep=[key, "section_ord", "title", "section_id"])
    return chunks.withColumn("passage_id", passage_id(key, "section_ord", "chunk_index"))


def passage_id(key: str, section_ord: str, chunk_index: str):
    """``<document>#<section>.<chunk>``, a unique key if documents are."""
    return F.format_string("%s#%d.%d", F.col(key).cast("string"), F.col(section_ord), F.col(chunk_index))


def ingest(spark: SparkSession, text_path: str, out_path: str, *, database: str | None = None,
           catalogue_csv: str | None = None, mapping_csv: str | None = None,
           paged: DataFrame | None = None, fmt: str = "parquet",
           chunk_tokens: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP, packed: bool = False) -> dict:
    """Read text files (one document per file, or several where ``packed``
    says that :func:`quarry.sources.documents.write_text_files` wrote them; a
    paged source wins per document), section and chunk them, write the chunk table, and the
    catalogue and clause map as all-string tables.  Returns the written
    locations."""
    texts = read_text_files(spark, text_path)
    texts = split_documents(texts) if packed else texts.select(F.col("path").alias("doc_id"), "text")
    if paged is not None:
        texts = prefer_paged(paged, texts, "doc_id").select("doc_id", "text")
    chunks = corpus_chunks(texts, chunk_tokens, overlap)
    out = {"chunks": f"{out_path.rstrip('/')}/chunks"}
    if database:
        TB.create_database(spark, database)
    TB.write_parquet(chunks, out["chunks"]) if not database else \
        TB.write_table(chunks, f"{database}.chunks", fmt, path=out["chunks"])
    for name, path, cols in (("catalogue", catalogue_csv, TB.CATALOGUE_COLUMNS),
                             ("clause_map", mapping_csv, TB.CLAUSE_MAP_COLUMNS)):
        if path:
            df = TB.read_csv_strings(spark, path, cols, ordinal="map_ord" if name == "clause_map" else None)
            out[name] = f"{out_path.rstrip('/')}/{name}"
            TB.write_parquet(df, out[name]) if not database else \
                TB.write_table(df, f"{database}.{name}", fmt, path=out[name])
    return out


def build_vectors(chunks: DataFrame, out_path: str, id_col: str = "passage_id", text_col: str = "text",
                  encoder_factory=None, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Encode every chunk, write the vector table and its manifest; returns
    the manifest row.  An empty chunk table raises."""
    vecs = build_vector_set(chunks, id_col, text_col, encoder_factory, buckets)
    TB.write_parquet(vecs, f"{out_path.rstrip('/')}/vectors")
    written = chunks.sparkSession.read.parquet(f"{out_path.rstrip('/')}/vectors")
    if "embedding" in written.columns:
        return TB.write_manifest(written, f"{out_path.rstrip('/')}/manifest", "embedding")
    return TB.write_manifest(written, f"{out_path.rstrip('/')}/manifest", "buckets", dim=buckets)


def update_vectors(chunks: DataFrame, out_path: str, id_col: str = "passage_id", text_col: str = "text",
                   encoder_factory=None, buckets: int = DEFAULT_BUCKETS, encoder: str | None = None) -> DataFrame:
    """Bring a vector set up to date; returns its manifest row.

    Vectors are kept in ``out_path/encoded`` under a digest of the text and
    the ``encoder``'s name (default: a digest of its factory, or the bucket
    count).  Only distinct texts whose digest is not there are encoded and
    appended; then ``out_path/vectors`` is written anew for the chunks as they
    are, by a join on the digest: vectors of chunks that are gone leave it and
    texts that come back are not encoded again.  A null text is an empty one.
    A run that fails in between keeps what it encoded.  One update at a time
    may run on a folder."""
    spark = chunks.sparkSession
    base = out_path.rstrip("/")
    if chunks.isEmpty():
        raise ValueError("passage table is empty; nothing to index")
    encoder = encoder or (f"hashed-{buckets}" if encoder_factory is None else factory_key(encoder_factory))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = chunks.select(id_col, F.sha2(F.concat(F.lit(encoder + "\n"), text), 256).alias("digest"), text.alias("text"))
    fresh = named.select("digest", "text").dropDuplicates(["digest"])
    known = _stored(spark, f"{base}/encoded")
    if known is not None:
        fresh = fresh.join(known.select("digest"), "digest", "left_anti")
    fresh = materialize(fresh)
    if not fresh.isEmpty():
        build_vector_set(fresh, "digest", "text", encoder_factory, buckets).write.mode("append").parquet(f"{base}/encoded")
    vectors = spark.read.parquet(f"{base}/encoded")
    TB.write_parquet(named.select(id_col, "digest").join(vectors, "digest").drop("digest"), f"{base}/vectors")
    written = spark.read.parquet(f"{base}/vectors")
    if "embedding" in written.columns:
        return TB.write_manifest(written, f"{base}/manifest", "embedding")
    return TB.write_manifest(written, f"{base}/manifest", "buckets", dim=buckets)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A table folder, or None where nothing has been written yet."""
    return spark.read.parquet(path) if TB.written(spark, path) else None


def corpus_profile(chunks: DataFrame, catalogue: DataFrame | None = None,
                   mapping: DataFrame | None = None, n: int = 10) -> dict:
    """Chunks per section (ordered by id) and the first ``n`` rows of the
    catalogue and the clause map, each in a fixed order."""
    out = {"chunks_per_section": chunk_counts(chunks, "section_id")}
    if catalogue is not None:
        out["catalogue_head"] = catalogue.orderBy(catalogue.columns[0]).limit(n)
    if mapping is not None:
        order = "map_ord" if "map_ord" in mapping.columns else mapping.columns[0]
        out["mapping_head"] = mapping.orderBy(order).limit(n)
    return out


def load_vectors(spark: SparkSession, out_path: str) -> tuple[DataFrame, DataFrame]:
    """A vector set written by :func:`build_vectors`: ``(vectors, manifest)``."""
    base = out_path.rstrip("/")
    return spark.read.parquet(f"{base}/vectors"), spark.read.json(f"{base}/manifest")
