"""Text -> vector encoders and vector-set utilities.

The default encoder (hashed term frequencies, L2-normalised) runs on whole
Arrow batches: Arrow kernels lower-case and split, numpy counts.  A model
encoder plugs in through ``mapInArrow``: it is built once per Python worker
and fed Arrow batches; its output is L2-normalised natively.
"""
from __future__ import annotations

import hashlib
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.vectors import DEFAULT_BUCKETS, l2_normalise
from quarry.operators.workers import factory_key, kept


def bucket_of(token: str, buckets: int) -> int:
    """First 32 bits of the token's md5 (UTF-8), modulo the bucket count."""
    return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % buckets


# Runs of anything but letters, marks and digits separate tokens (the
# complement of the token pattern).
_SEPARATOR = r"[^\p{L}\p{M}\p{N}]+"
_SLICE_BYTES = 1 << 20  # texts that are encoded at once: their tokens take many times their bytes
_BUCKET_MEMO: dict = {}


def _memo_bucket(token: str, buckets: int) -> int:
    key = (token, buckets)
    b = _BUCKET_MEMO.get(key)
    if b is None:
        if len(_BUCKET_MEMO) > 250_000:  # bounded: ~40 MB per worker
            _BUCKET_MEMO.clear()
        b = _BUCKET_MEMO[key] = bucket_of(token, buckets)
    return b


def term_vectors(texts: pa.Array, buckets: int):
    """Texts -> (bucket ids, weights) as two list arrays, one entry per
    distinct bucket of a text, weights = counts / L2 norm of the counts.

    Lower-casing and splitting are Arrow kernels (RE2) over the whole batch;
    each distinct token of the batch is hashed once; counting is one
    lexsort over (row, bucket)."""
    n_rows = len(texts)
    parts = pc.split_pattern_regex(pc.utf8_lower(texts), pattern=_SEPARATOR)
    flat = pc.list_flatten(parts)
    parent = pc.list_parent_indices(parts)
    keep = pc.greater(pc.utf8_length(flat), 0)
    flat, parent = flat.filter(keep), np.asarray(parent.filter(keep), dtype=np.int64)
    if len(flat):
        enc = pc.dictionary_encode(flat)
        table = np.fromiter((_memo_bucket(t, buckets) for t in enc.dictionary.to_pylist()),
                            dtype=np.int64, count=len(enc.dictionary))
        ids = table[np.asarray(enc.indices, dtype=np.int64)]
        order = np.lexsort((ids, parent))
        ids, parent = ids[order], parent[order]
        new = np.r_[True, (ids[1:] != ids[:-1]) | (parent[1:] != parent[:-1])]
        starts = np.flatnonzero(new)
        tf = np.diff(np.r_[starts, len(ids)]).astype(np.float64)
        run_row = parent[starts]
        per_row = np.bincount(run_row, minlength=n_rows)
        norm = np.sqrt(np.bincount(run_row, weights=tf * tf, minlength=n_rows))
        out_ids, out_w = ids[starts].astype(np.int32), tf / norm[run_row]
    else:
        per_row = np.zeros(n_rows, np.int64)
        out_ids, out_w = np.zeros(0, np.int32), np.zeros(0)
    offsets = pa.array(np.r_[0, np.cumsum(per_row)].astype(np.int32))
    return (pa.ListArray.from_arrays(offsets, pa.array(out_ids, pa.int32())),
            pa.ListArray.from_arrays(offsets, pa.array(out_w, pa.float64())))


def text_slices(batch: pa.RecordBatch, column: int, limit: int):
    """A batch cut into slices whose texts have about ``limit`` bytes, one row
    at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    ends = np.cumsum(size)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def hashed_vectors(df: DataFrame, text_col: str = "text", keep=None,
                   buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Sparse unit vectors ``buckets array<int>, weights array<double>``.

    One ``mapInArrow`` pass over Arrow batches of (keep..., text): tokens are
    found and hashed per batch, equal ids counted and L2-divided with numpy
    over slices of bounded bytes of the batch.  A narrow transformation: no
    shuffle, whatever the size of a document; texts never leave their
    partition."""
    keep = [c for c in (keep if keep is not None else df.columns)
            if c not in ("buckets", "weights", "_tb")]
    src = df.select(*keep, F.col(text_col).cast("string").alias("_tb"))
    fields = [f for f in src.schema.fields if f.name != "_tb"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema = (schema + ", " if schema else "") + "buckets array<int>, weights array<double>"

    def run(batches):
        for b in (x for batch in batches for x in text_slices(batch, batch.schema.get_field_index("_tb"), _SLICE_BYTES)):
            i = b.schema.get_field_index("_tb")
            ids, weights = term_vectors(b.column(i), buckets)
            cols = [b.column(j) for j in range(b.num_columns) if j != i]
            names = [nm for j, nm in enumerate(b.schema.names) if j != i]
            yield pa.RecordBatch.from_arrays(cols + [ids, weights], names=names + ["buckets", "weights"])

    return src.mapInArrow(run, schema)


def sparse_long(vectors: DataFrame, keys) -> DataFrame:
    """Long form ``keys..., bucket, weight`` of sparse vectors."""
    keys = list(keys)
    return vectors.select(*keys, F.inline(F.arrays_zip(F.col("buckets").alias("bucket"),
                                                       F.col("weights").alias("weight"))))


def embed(df: DataFrame, encoder_factory: Callable[[], Callable[[list], np.ndarray]],
          text_col: str = "text", keep=None, batch_size: int = 32) -> DataFrame:
    """Dense unit vectors ``embedding array<float>`` from a model:
    ``encoder_factory()`` returns a callable mapping a list of texts to an
    (n x dim) array; nulls go in as ''.  Only ``keep`` and the text travel to
    Python, in Arrow batches; the model is built once per worker."""
    keep = [c for c in (keep if keep is not None else df.columns) if c not in ("embedding", "_text")]
    src = df.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "_text"]
    key = factory_key(encoder_factory)

    def run(batches):
        encode = kept(key, encoder_factory)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            parts = [np.asarray(encode(texts[i:i + batch_size]), dtype=np.float64)
                     for i in range(0, len(texts), batch_size)]
            rows = np.concatenate(parts) if parts else np.zeros((0, 1))
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * rows.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(keep))]
                + [pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], names=keep + ["_raw"])

    raw = src.mapInArrow(run, ", ".join(fields + ["_raw array<double>"]))
    return raw.select(*keep, l2_normalise("_raw").cast("array<float>").alias("embedding"))


def build_vector_set(passages: DataFrame, id_col: str = "passage_id", text_col: str = "text",
                     encoder_factory=None, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Vectors of a passage table (default encoder: hashed terms; else a
    model through :func:`embed`).  An empty passage table cannot be indexed."""
    if passages.isEmpty():
        raise ValueError("passage table is empty; nothing to index")
    if encoder_factory is None:
        return hashed_vectors(passages, text_col, keep=[id_col], buckets=buckets)
    return embed(passages, encoder_factory, text_col, keep=[id_col])
