"""Near-duplicate vectors by randomised-rotation binary codes.

Every vector is turned by random rotations; the signs are its binary code and
the inner product of the code with the turned vector its correction factor.
Bands of code bits are bucket keys: their width grows with the logarithm of
the table, so buckets of unrelated vectors stay small, and their number is
set so that a pair at the threshold misses all bands with a probability of at
most ``miss``.  Inside a bucket a pair's inner product is estimated from one
side's code and factor and the other side's turned vector, which is unbiased
over rotations; pairs whose confidence bound reaches the threshold are
recomputed exactly in doubles, and only exact values make links.

A pair is counted in its first common band only.  A bucket above
``block_rows`` is cut into blocks that meet pairwise in different tasks;
links leave a task as counts and spanning-forest edges, never as pairs.
Equal vectors are one class throughout.

Null, zero, empty vectors and such with null or non-finite components link
with nothing, as do rows without an id; vectors of different lengths do not
link.  Rows that share an id share a component.  An empty table gives an
empty table.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.session import materialize

SIGMAS = 5.0  # width of the confidence bound
ESTIMATE_TURNS = 4  # rotations whose bits estimate inner products


def rotations(dim: int, count: int) -> np.ndarray:
    """``count`` random rotations of ``dim`` dimensions, stacked; fixed by
    ``dim`` and the rotation's number."""
    made = []
    for k in range(count):
        q, r = np.linalg.qr(np.random.default_rng([dim, k]).standard_normal((dim, dim)))
        made.append(q * np.sign(np.diag(r)))
    return np.concatenate(made)


def plan_bands(rows: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a band and number of bands for a table of ``rows`` vectors."""
    width = min(48, max(8, math.ceil(math.log2(max(2, rows))) + 4))
    agree = (1 - math.acos(threshold) / math.pi) ** width
    return width, math.ceil(math.log(miss) / math.log1p(-agree))


def turned(x: np.ndarray, dim: int, turns: int) -> np.ndarray:
    return x @ _rotations(dim, turns).T


_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def _rotations(dim: int, count: int) -> np.ndarray:
    if (dim, count) not in _ROTATIONS:
        _ROTATIONS[dim, count] = rotations(dim, count)
    return _ROTATIONS[dim, count]


def band_keys(signs: np.ndarray, width: int, bands: int) -> np.ndarray:
    """The value of each band of each row's sign bits."""
    bits = signs[:, :width * bands].reshape(len(signs), bands, width).astype(np.int64)
    return bits @ (np.int64(1) << np.arange(width, dtype=np.int64))


def _vectors(blobs: pa.Array) -> np.ndarray:
    """Equal-length rows of float64 stored as binary."""
    blobs = pa.concat_arrays([blobs]).cast(pa.large_binary())
    data = np.frombuffer(b"".join(blobs.to_pylist()), np.float64)
    return data.reshape(len(blobs), -1)


def encode(classes: DataFrame, width: int, bands: int) -> DataFrame:
    """``id, dim, m, vec`` with ``keys`` (one per band) and ``factor``."""
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _vectors(part.column("vec"))
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                turns = max(math.ceil(width * bands / dim), ESTIMATE_TURNS)
                y = turned(x, int(dim), turns)
                keys = band_keys(y > 0, width, bands)
                own = y[:, :ESTIMATE_TURNS * dim]
                factor = np.abs(own).sum(1) / math.sqrt(ESTIMATE_TURNS) / math.sqrt(own.shape[1])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(x) + 1) * bands, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("id", "dim", "m", "vec")] + [lists, pa.array(factor)],
                    names=["id", "dim", "m", "vec", "keys", "factor"])

    return classes.select("id", "dim", "m", "vec").mapInArrow(
        run, "id long, dim int, m long, vec binary, keys array<long>, factor double")


def _runs(batches, key: str):
    """Batches regrouped so that rows of one ``key`` (sorted) stay together."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _pair_links(ids, m, group, side, band, keys, x, factor, threshold):
    """Links of a table of blocks (rows of a block adjacent): weighted counts
    per row and the row pairs that are linked."""
    n, dim = x.shape
    norm = np.linalg.norm(x, axis=1)
    y = turned(x / norm[:, None], dim, ESTIMATE_TURNS) / math.sqrt(ESTIMATE_TURNS)
    code = np.where(y > 0, 1.0, -1.0).astype(np.float32) / np.float32(math.sqrt(y.shape[1]))
    y = y.astype(np.float32)
    spread = np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, y.shape[1] - 1))
    links, left, right = np.zeros(n, np.int64), [], []
    step = 1
    while step < n:
        a = np.flatnonzero(group[step:] == group[:-step])
        if len(a) == 0:
            break
        b = a + step
        meet = (side[a] < 0) | (side[a] != side[b])  # blocks of two parts compare across only
        a, b = a[meet], b[meet]
        for i in range(0, len(a), 65536):
            p, q = a[i:i + 65536], b[i:i + 65536]
            estimate = np.einsum("ij,ij->i", code[p], y[q]) / factor[p]
            near = estimate + SIGMAS * spread[p] >= threshold
            p, q = p[near], q[near]
            exact = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q])
            p, q = p[exact >= threshold], q[exact >= threshold]
            left.append(p)
            right.append(q)
            fresh = (band[p] == band[q]) & (np.argmax(keys[p] == keys[q], axis=1) == band[p])
            np.add.at(links, p[fresh], m[q[fresh]])
            np.add.at(links, q[fresh], m[p[fresh]])
        step += 1
    return links, np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest row index reachable over the row pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def linked(blocks: DataFrame, threshold: float) -> DataFrame:
    """``id, links, root`` per row of a block that has links."""
    def run(batches):
        for table in _runs(batches, "block"):
            dims = table.column("dim").to_numpy()
            for dim in np.unique(dims):
                t = table.filter(pa.array(dims == dim)).combine_chunks()
                ids = t.column("id").to_numpy()
                order = np.lexsort((ids, t.column("block").to_numpy()))
                t, ids = t.take(pa.array(order)), ids[order]
                keys = t.column("keys").combine_chunks()
                keys = keys.flatten().to_numpy().reshape(len(ids), -1)
                links, a, b = _pair_links(
                    ids, t.column("m").to_numpy(), t.column("block").to_numpy(), t.column("side").to_numpy(),
                    t.column("band").to_numpy(), keys, _vectors(t.column("vec").combine_chunks()),
                    t.column("factor").to_numpy(), threshold)
                root = _roots(len(ids), a, b)
                use = np.zeros(len(ids), bool)
                use[a] = use[b] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[use]), pa.array(links[use]), pa.array(ids[root[use]])],
                    names=["id", "links", "root"])

    return blocks.mapInArrow(run, "id long, links long, root long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 threshold: float = 0.95, miss: float = 1e-4, block_rows: int = 512) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row (ids are longs)."""
    def pack(batches):
        for batch in batches:
            blobs, dims = [], []
            for value in batch.column(1).to_pylist():
                x = None
                if value and None not in value:
                    x = np.array(value, np.float64)
                    if not (np.isfinite(x).all() and x.any()):
                        x = None
                blobs.append(None if x is None else x.tobytes())
                dims.append(None if x is None else len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(blobs, pa.binary()), pa.array(dims, pa.int32())],
                names=["vec_id", "vec", "dim"])

    rows = materialize(
        vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))
        .mapInArrow(pack, "vec_id long, vec binary, dim int")
        .withColumn("vec", F.when(F.col("vec_id").isNotNull(), F.col("vec")))
        .withColumn("h", F.when(F.col("vec").isNotNull(), F.sha2("vec", 256))))
    # A class of equal vectors has a number of its own: ids may repeat.
    classes = materialize(rows.filter("h is not null").groupBy("h").agg(
        F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("m"), F.first("vec").alias("vec"),
        F.first("dim").alias("dim")).withColumn("id", F.monotonically_increasing_id()))
    width, bands = plan_bands(classes.count(), threshold, miss)
    codes = materialize(encode(classes, width, bands))

    members = codes.select("id", F.posexplode("keys").alias("band", "key"), "dim")
    # band, key and length as one number; unequal ones that collide only meet in vain
    members = members.select("id", "band", F.xxhash64("band", "key", "dim").alias("bucket"))
    full = materialize(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    parts = F.ceil(F.col("n") / F.lit(block_rows)).cast("int")
    mine = F.pmod(F.xxhash64("bucket", "id"), F.col("parts")).cast("int")
    placed = (members.join(full, "bucket").withColumn("parts", parts).withColumn("part", mine)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("id", "band", F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))
                      .alias("block"),
                      F.when(F.col("part") == F.col("other"), -1).otherwise(F.col("part")).alias("side"),
                      (F.col("part") == F.col("other")).alias("whole")))
    # A block of two parts holds rows of either part; a part's own block holds it whole.
    blocks = (placed.drop("whole").join(codes, "id")
              .repartition("block").sortWithinPartitions("block"))
    found = materialize(linked(blocks, threshold))

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    own = rows.filter("h is not null").select("vec_id", "h").distinct().join(classes.select("h", "id"), "h")
    shared = (own.groupBy("vec_id").agg(F.min("id").alias("root"), F.max("id").alias("last"))
              .filter("root != last").select("vec_id", "root"))
    edges = found.select("id", "root").unionByName(own.join(shared, "vec_id").select("id", "root"))
    group = components(edges, "id", "root")
    classes = materialize(classes.select("h", "id", "low", "m").join(links, "id", "left").join(group, "id", "left")
                          .select("h", "low", F.coalesce("component", "id").alias("component"),
                                  (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")))
    least = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = classes.join(least, "component").select("h", "component_id", "n_links")
    return (rows.select("vec_id", "h").join(classes, "h", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
