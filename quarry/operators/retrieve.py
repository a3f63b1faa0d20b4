"""Question -> passages and question -> catalogue rows.

``retrieve`` is the top-k search with the minimum-score rule: keep rank <= k
with score >= min, but always keep rank 1 (rank 1 holds the highest score, so
one predicate suffices and no second pass is needed).  ``match_catalogue``
ranks a catalogue by the same search and keeps only rows over the minimum
(no fallback).  Passage texts and catalogue columns are joined *after* the
ranking, so they never travel through the scoring step.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import strip
from quarry.operators.embed import embed, hashed_vectors
from quarry.operators.search import search

# Defaults of the reference.
TOP_K = 5
MIN_SCORE = 0.55
CATALOGUE_K = 3
CATALOGUE_MIN = 0.25


def non_blank(df: DataFrame, text_col: str) -> DataFrame:
    """A blank (or null) question gets no results."""
    return df.filter(strip(F.coalesce(F.col(text_col), F.lit(""))) != "")


def keep_min_score(hits: DataFrame, k: int, min_score: float, fallback: bool = True) -> DataFrame:
    cond = (F.col("rank") <= k) & (F.col("score") >= min_score)
    if fallback:
        cond = (F.col("rank") <= k) & ((F.col("score") >= min_score) | (F.col("rank") == 1))
    return hits.filter(cond)


def text_search(questions: DataFrame, passages: DataFrame, k: int, *, question_id: str,
                question_text: str, passage_id: str, passage_vectors: DataFrame | None = None,
                passage_text: str = "text", encoder_factory=None, min_score: float | None = None,
                fallback: bool = True, attach=None, meta: DataFrame | None = None,
                **search_kw) -> DataFrame:
    """Top-k of texts against passages: ``query_id, hit_id, score, rank`` plus
    the ``attach`` columns of ``meta`` (default: the passages).

    Both sides are encoded by ``encoder_factory`` (dense) or, without one, by
    the default encoder (sparse); ``passage_vectors`` is a stored vector table
    of the passages.  Each distinct question text is scored once; the
    minimum-score rule and the metadata join run on those hits, at most k per
    text, and then every question takes the hits of its text.  The joins are
    plain: AQE broadcasts the side it measures as small and splits hot texts.
    A question that shares no term with any passage has a best hit of score
    0, the passage with the smallest id."""
    q = non_blank(questions, question_text)
    distinct = q.select(F.col(question_text).alias("_qtext")).distinct()
    if encoder_factory is not None:
        kind = "dense"
        qv = embed(distinct, encoder_factory, "_qtext", keep=["_qtext"])
        pv = passage_vectors if passage_vectors is not None else embed(
            passages.select(passage_id, passage_text), encoder_factory, passage_text, keep=[passage_id])
    else:
        kind = "sparse"
        qv = hashed_vectors(distinct, "_qtext", keep=["_qtext"])
        pv = passage_vectors
        if pv is None:  # encoded inside the scoring tasks
            pv = passages.select(passage_id, passage_text)
            search_kw = dict(search_kw, corpus_text=passage_text)
    hits = search(qv, pv, k, kind=kind, question_id="_qtext", corpus_id=passage_id, **search_kw)
    if min_score is not None:
        hits = keep_min_score(hits, k, min_score, fallback)
    meta = passages if meta is None else meta
    attach = [c for c in (attach or []) if c in meta.columns and c != passage_id]
    if attach:
        hits = attach_passages(hits, meta, passage_id, attach, fill_title=False)
    hits = hits.withColumnRenamed("query_id", "_qtext")
    return (q.select(F.col(question_id).alias("query_id"), F.col(question_text).alias("_qtext"))
            .join(hits, "_qtext").select("query_id", "hit_id", "score", "rank", *attach))


def retrieve(questions: DataFrame, passages: DataFrame, k: int = TOP_K,
             min_score: float = MIN_SCORE, *, question_id: str = "query_id",
             question_text: str = "question", passage_id: str = "passage_id",
             attach=None, vectors: DataFrame | None = None, encoder_factory=None, **kw) -> DataFrame:
    """Passages per question: ``query_id, rank, hit_id, score`` plus the
    passage columns named in ``attach`` (a missing title becomes '').
    ``passage_id`` must be a key of the passages.  ``vectors`` is a stored
    vector table to score against instead of encoding the passages on the
    fly: ``passage_id`` with ``buckets, weights``, or with ``embedding`` made
    by the same ``encoder_factory``."""
    if vectors is not None and ("embedding" in vectors.columns) != (encoder_factory is not None):
        raise ValueError("dense vectors need the encoder that made them, sparse ones the default encoder")
    hits = text_search(questions, passages, k, question_id=question_id, question_text=question_text,
                       passage_id=passage_id, passage_vectors=vectors, encoder_factory=encoder_factory,
                       min_score=min_score, fallback=True, attach=attach, **kw)
    if "title" in hits.columns:
        hits = hits.withColumn("title", F.coalesce("title", F.lit("")))
    return hits


def attach_passages(hits: DataFrame, passages: DataFrame, passage_id: str = "passage_id",
                    columns=("section_id", "title", "text"), fill_title: bool = True) -> DataFrame:
    """Join passage metadata to ranked hits (a missing title becomes '')."""
    cols = [c for c in columns if c in passages.columns]
    out = hits.join(passages.select(F.col(passage_id).alias("hit_id"), *cols), "hit_id")
    if fill_title and "title" in cols:
        out = out.withColumn("title", F.coalesce("title", F.lit("")))
    return out


def catalogue_text(df: DataFrame, name: str = "name", description: str = "description",
                   eligibility: str = "eligibility") -> F.Column:
    """``name. description. Eligibility: eligibility`` with nulls as ''."""
    def z(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(z(name), F.lit(". "), z(description), F.lit(". Eligibility: "), z(eligibility))


def catalogue_vectors(catalogue: DataFrame, *, catalogue_id: str = "scheme_id", name: str = "name",
                      description: str = "description", eligibility: str = "eligibility",
                      encoder_factory=None) -> DataFrame:
    """Vectors of a catalogue, to be stored once and passed to
    :func:`match_catalogue`."""
    docs = catalogue.select(catalogue_id, catalogue_text(catalogue, name, description, eligibility).alias("_ctext"))
    if encoder_factory is None:
        return hashed_vectors(docs, "_ctext", keep=[catalogue_id])
    return embed(docs, encoder_factory, "_ctext", keep=[catalogue_id])


def match_catalogue(questions: DataFrame, catalogue: DataFrame, k: int = CATALOGUE_K,
                    min_score: float = CATALOGUE_MIN, *, question_id: str = "query_id",
                    question_text: str = "question", catalogue_id: str = "scheme_id",
                    name: str = "name", description: str = "description",
                    eligibility: str = "eligibility", vectors: DataFrame | None = None,
                    encoder_factory=None, **kw) -> DataFrame:
    """Top catalogue rows per question over ``min_score`` (no fallback):
    ``query_id, rank, hit_id, score`` plus every catalogue column.  ``vectors``
    are stored catalogue vectors (:func:`catalogue_vectors`)."""
    docs = catalogue.select(catalogue_id, catalogue_text(catalogue, name, description, eligibility)
                            .alias("_ctext"))
    cat_cols = [c for c in catalogue.columns if c != catalogue_id]
    return text_search(questions, docs, k, question_id=question_id, question_text=question_text,
                       passage_id=catalogue_id, passage_text="_ctext", passage_vectors=vectors,
                       encoder_factory=encoder_factory, min_score=min_score,
                       fallback=False, attach=cat_cols, meta=catalogue, **kw)
