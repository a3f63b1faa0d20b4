"""Exact top-k search of question vectors against a corpus of vectors.

Scores are inner products (cosine on unit vectors), rounded to 6 digits and
ranked by (score desc, corpus id asc), so ties are broken the same way
everywhere.  No pair of (question, passage) ever becomes a row.

The bytes of all questions are summed first.  If they fit one block of
``block_bytes``, the block is broadcast and met by one scan of the corpus,
which is neither copied nor shuffled.  Any larger number of questions meets
the corpus in a grid of tasks (:mod:`quarry.operators.grid`): questions are cut
into groups of a block each, the corpus into columns; it is read and encoded
once and copied once per group of questions, and no question passes the
driver.  Both ways run the same kernel and give the same rows.  A group is as
large as a task may hold (``CELL_BYTES``), however small a block is, and the
grid has no more cells than the cluster keeps busy: the copies that are
shuffled are few.

A task scores Arrow batches with matrix products over bounded sub-blocks of
its questions (sparse questions are held as lists and become a matrix of at
most ``_MATRIX_CELLS`` values at a time), keeps an exact running top-k per
question (:class:`Best`: scores below a question's k-th best so far are left
by one comparison) and emits at most ``k`` rows per question.  The corpus is
read by at most ``scan_tasks`` tasks, so the candidates that are shuffled for
the rank grow with the cluster and not with the corpus.

Vectors are either ``dense`` (``embedding array<float|double>``) or
``sparse`` (``buckets array<int>, weights array<double>``, sorted buckets).
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.embed import text_slices
from quarry.operators.grid import cells, grid
from quarry.session import materialize

# Work per scoring step: about this many (passage x question) scores at once.
_STEP_CELLS = 2_000_000
_MATRIX_CELLS = 2_000_000  # values of a question matrix (16 MB)
_TILE_CELLS = 1 << 19  # scores that are compared at once (4 MB)
_TILE_QUESTIONS = 1024
_ROUND = 1e-6  # above what rounding to 6 digits and summing in another order may lift a score
_BATCH_TEXT = 1 << 20  # bytes of texts that are encoded at once
BLOCK_BYTES = 32 << 20
CELL_BYTES = 32 << 20  # questions of a cell of the grid


# ------------------------------------------------------------------ kernels

def prepare_questions(ids, kind: str, dense=None, lengths=None, buckets=None, weights=None):
    """Question block as numpy: ids plus a dense matrix (dense) or the lists
    of buckets and weights (sparse)."""
    ids = np.asarray(ids)
    if kind == "dense":
        return {"kind": kind, "ids": ids, "q": np.asarray(dense, dtype=np.float64).reshape(len(ids), -1)}
    off = np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.int64))])
    return {"kind": kind, "ids": ids, "off": off, "buckets": np.asarray(buckets, dtype=np.int64),
            "weights": np.asarray(weights, dtype=np.float64)}


def built_bytes(prep) -> int:
    """Bytes of a prepared block."""
    return sum(v.nbytes for v in prep.values() if isinstance(v, np.ndarray))


def sub_blocks(prep):
    """Prepared blocks whose matrix has at most ``_MATRIX_CELLS`` values (one
    question at least) and so many questions as a tile takes; a sparse block
    that is one by itself keeps its matrix."""
    if prep["kind"] == "dense":
        for lo in range(0, len(prep["ids"]), _TILE_QUESTIONS):
            q = prep["q"][lo:lo + _TILE_QUESTIONS]
            yield {"kind": "dense", "ids": prep["ids"][lo:lo + len(q)], "q": q}
        return
    if "q" in prep:
        yield prep
        return
    off, n = prep["off"], len(prep["ids"])
    if "cuts" not in prep:
        prep["cuts"] = _cuts(prep)
    for lo, hi in prep["cuts"]:
        mine, w = prep["buckets"][off[lo]:off[hi]], prep["weights"][off[lo]:off[hi]]
        used = np.unique(mine)
        q = np.zeros((len(used), hi - lo), dtype=np.float64)
        if len(mine):
            q[np.searchsorted(used, mine), np.repeat(np.arange(hi - lo), np.diff(off[lo:hi + 1]))] = w
        part = {"kind": "sparse", "ids": prep["ids"][lo:hi], "used": used, "q": q}
        if hi - lo == n:
            prep.update(used=used, q=q)
        yield part


def _cuts(prep) -> list[tuple[int, int]]:
    """Runs of questions whose matrices are small enough, each the longest."""
    off, n = prep["off"], len(prep["ids"])
    lo, cuts = 0, []
    while lo < n:
        hi, step = lo + 1, n - lo
        while step:
            if hi + step <= n and len(np.unique(prep["buckets"][off[lo]:off[hi + step]])) * (hi + step - lo) <= _MATRIX_CELLS:
                hi += step
            else:
                step //= 2
        cuts.append((lo, hi))
        lo = hi
    return cuts


def score_block(prep, n_c: int, dense=None, lengths=None, buckets=None, weights=None) -> np.ndarray:
    """(n_c x n_q) inner products of a passage block with the question block."""
    n_q = len(prep["ids"])
    if prep["kind"] == "dense":
        c = np.asarray(dense, dtype=np.float64).reshape(n_c, -1)
        if c.shape[1] != prep["q"].shape[1]:
            raise ValueError("passage and question vectors differ in dimension")
        return c @ prep["q"].T
    s = np.zeros((n_c, n_q), dtype=np.float64)
    used, qmat = prep["used"], prep["q"]
    if n_c == 0 or len(used) == 0 or len(buckets) == 0:
        return s
    row = np.repeat(np.arange(n_c), np.asarray(lengths, dtype=np.int64))
    b = np.asarray(buckets, dtype=np.int64)
    pos = np.minimum(np.searchsorted(used, b), len(used) - 1)
    hit = used[pos] == b
    row, pos, w = row[hit], pos[hit], np.asarray(weights, dtype=np.float64)[hit]
    if len(row) == 0:
        return s
    # Dense slices over the buckets the questions use: one BLAS product each.
    step = max(1, _STEP_CELLS // len(used))
    bounds = np.searchsorted(row, np.arange(0, n_c + step, step))
    for k0, r0 in enumerate(range(0, n_c, step)):
        r1 = min(n_c, r0 + step)
        e0, e1 = bounds[k0], bounds[k0 + 1]
        m = np.zeros((r1 - r0, len(used)), dtype=np.float64)
        m[row[e0:e1] - r0, pos[e0:e1]] = w[e0:e1]
        s[r0:r1] = m @ qmat
    return s


def local_top_k(qids, cids: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """Exact top-k per question of one block under (round6 desc, id asc)."""
    n_c, n_q = scores.shape
    if n_c == 0 or n_q == 0:
        return pd.DataFrame({"query_id": qids[:0], "hit_id": cids[:0], "score": np.zeros(0)})
    key = np.round(scores, 6)
    perm = np.argsort(cids, kind="stable")
    key, cids = key[perm], cids[perm]
    kk = min(k, n_c)
    thr = np.partition(key, n_c - kk, axis=0)[n_c - kk]
    gt = key > thr
    need = kk - gt.sum(axis=0)
    eq = key == thr
    sel = gt | (eq & (np.cumsum(eq, axis=0) <= need))
    sel &= np.isfinite(key)
    ri, qj = np.nonzero(sel)
    return pd.DataFrame({"query_id": qids[qj], "hit_id": cids[ri], "score": key[ri, qj]})


def merge_top_k(frames, k: int) -> pd.DataFrame:
    df = pd.concat(frames, ignore_index=True)
    if len(df) == 0:
        return df
    df = df.sort_values(["query_id", "score", "hit_id"], ascending=[True, False, True], kind="stable")
    return df.groupby("query_id", sort=False).head(k)


class Best:
    """The best ``k`` hits so far of some questions.  Scores are offered as
    tiles (passages by questions); a score that cannot reach its question's
    k-th best after rounding is left by one comparison."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.place = np.arange(len(ids))
        self.least = np.full(len(ids), -np.inf)  # k-th best score of each question
        self.kept, self.new, self.waiting = None, [], 0

    def offer(self, cids: np.ndarray, scores: np.ndarray, error: float = 0.0, exact=None) -> None:
        """``scores`` may differ by ``error`` from the true ones; those of
        chosen (passages, questions), or of all, are then given by ``exact``."""
        bar = (self.least - (_ROUND + error)).astype(scores.dtype)
        bar = np.maximum(bar, np.finfo(scores.dtype).min)  # pairs that are masked never pass
        some = np.flatnonzero(np.fmax.reduce(scores, axis=0, initial=-np.inf) >= bar)  # questions that may find a hit
        tile = scores
        if 4 * len(some) < len(bar):
            tile, bar = scores[:, some], bar[some]
        else:
            some = self.place
        near = np.flatnonzero(tile >= bar)
        if len(near) > 2 * self.k * len(self.ids):  # nothing is known yet, or many scores are equal
            found = local_top_k(self.place, cids, scores if exact is None else exact(None, None), self.k)
        elif len(near):
            ri, qj = np.divmod(near, len(some))
            qj = some[qj]
            key = np.round(scores[ri, qj] if exact is None else exact(ri, qj), 6)
            use = (key >= self.least[qj]) & np.isfinite(key)
            found = pd.DataFrame({"query_id": qj[use], "hit_id": cids[ri[use]], "score": key[use]})
        else:
            return
        self.new.append(found)
        self.waiting += len(found)
        if 2 * self.waiting >= self.k * len(self.ids):
            self.settle()

    def settle(self) -> None:
        if not self.new:
            return
        self.kept = merge_top_k(self.new if self.kept is None else [self.kept, *self.new], self.k)
        self.new, self.waiting = [], 0
        place = self.kept["query_id"].to_numpy()
        last = np.flatnonzero(np.append(place[1:] != place[:-1], True)) if len(place) else np.zeros(0, np.int64)
        full = np.bincount(place, minlength=len(self.ids))[place[last]] == self.k
        self.least[place[last[full]]] = self.kept["score"].to_numpy()[last[full]]

    def hits(self) -> pd.DataFrame | None:
        """Rows ``query_id, hit_id, score``."""
        self.settle()
        if self.kept is None or len(self.kept) == 0:
            return None
        return self.kept.assign(query_id=self.ids[self.kept["query_id"].to_numpy()])


def _arrow_list(arr: pa.Array):
    lengths = np.asarray(arr.value_lengths().fill_null(0), dtype=np.int64)
    return lengths, np.asarray(arr.flatten())


def _encode_text(arr: pa.Array, buckets: int):
    from quarry.operators.embed import term_vectors

    ids, weights = term_vectors(arr, buckets)
    return {"lengths": np.asarray(ids.value_lengths(), dtype=np.int64),
            "buckets": np.asarray(ids.flatten()), "weights": np.asarray(weights.flatten())}


def _block_from_arrow(batch: pa.RecordBatch, kind: str, text_buckets: int | None = None):
    if text_buckets:
        return _encode_text(batch.column(1), text_buckets)
    if kind == "dense":
        lengths, flat = _arrow_list(batch.column(1))
        if len(lengths) and (lengths.min() != lengths.max()):
            raise ValueError("vectors of different dimensions in one set")
        return {"dense": flat}
    lb, fb = _arrow_list(batch.column(1))
    _, fw = _arrow_list(batch.column(2))
    return {"lengths": lb, "buckets": fb, "weights": fw}


def _slice_block(block, kind, lo, hi, row_offsets=None):
    if kind == "dense":
        d = block["dense"]
        width = len(d) // max(1, block["n"])
        return {"dense": d[lo * width:hi * width]}
    off = row_offsets
    return {"lengths": block["lengths"][lo:hi], "buckets": block["buckets"][off[lo]:off[hi]],
            "weights": block["weights"][off[lo]:off[hi]]}


def score_and_select(prep, cids: np.ndarray, block, kind: str, bests: list, k: int, own: np.ndarray | None) -> None:
    """Offer a passage block in tiles to the questions' best hits (``bests``,
    one for each sub-block).  ``own`` holds the place of the question that a
    passage may not be a hit of, or -1."""
    n_c = len(cids)
    block = dict(block, n=n_c)
    offs = np.r_[0, np.cumsum(block["lengths"])] if kind == "sparse" else None
    if kind == "dense":
        c = np.asarray(block["dense"], dtype=np.float64).reshape(n_c, -1)
        if c.shape[1] != prep["q"].shape[1]:
            raise ValueError("passage and question vectors differ in dimension")
    first = 0
    for i, sub in enumerate(sub_blocks(prep)):
        n_q = len(sub["ids"])
        if i == len(bests):
            bests.append(Best(sub["ids"], k))
        step = max(64, _TILE_CELLS // max(1, n_q))
        for lo in range(0, n_c, step):
            hi = min(n_c, lo + step)
            if own is not None:
                at = own[lo:hi] - first
                mine = np.flatnonzero((at >= 0) & (at < n_q))
                mine = (mine, at[mine])
            else:
                mine = None
            if kind == "dense":
                _offer_dense(bests[i], cids[lo:hi], c[lo:hi], sub["q"], mine)
            else:
                s = score_block(sub, hi - lo, **_slice_block(block, kind, lo, hi, offs))
                if mine is not None:
                    s[mine] = -np.inf
                bests[i].offer(cids[lo:hi], s)
        first += n_q


def _offer_dense(best: Best, cids: np.ndarray, c: np.ndarray, q: np.ndarray, mine) -> None:
    """Products in single precision choose what is worth a product in double
    precision.  Their error is bounded by the vectors' lengths."""
    def exact(ri, qj):
        if ri is not None:
            return np.einsum("ij,ij->i", c[ri], q[qj])
        s = c @ q.T
        if mine is not None:
            s[mine] = -np.inf
        return s

    def longest(v):
        return math.sqrt(np.fmax.reduce(np.einsum("ij,ij->i", v, v), initial=0.0))

    error = (c.shape[1] + 4) * 2.0 ** -23 * longest(c) * longest(q)
    if not error < 1e18:  # too long for single precision
        best.offer(cids, exact(None, None))
        return
    s = c.astype(np.float32) @ q.astype(np.float32).T
    if mine is not None:
        s[mine] = -np.inf
    best.offer(cids, s, error, exact)


# ------------------------------------------------------------ Spark plans

def _vector_cols(kind: str):
    return ["embedding"] if kind == "dense" else ["buckets", "weights"]


def _out_schema(questions: DataFrame, corpus: DataFrame, qid: str, cid: str) -> str:
    qt = questions.schema[qid].dataType.simpleString()
    ct = corpus.schema[cid].dataType.simpleString()
    return f"query_id {qt}, hit_id {ct}, score double"


def _rank(cands: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("hit_id"))
    return cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _prepared(table: pa.Table, kind: str):
    """A prepared block of the rows (id, vector columns) of an Arrow table."""
    table = table.combine_chunks()
    columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns]
    ids = np.asarray(columns[0].to_numpy(zero_copy_only=False))
    lengths, flat = _arrow_list(columns[1])
    if kind == "dense":
        if len(lengths) and lengths.min() != lengths.max():
            raise ValueError("vectors of different dimensions in one set")
        return prepare_questions(ids, kind, dense=flat)
    return prepare_questions(ids, kind, lengths=lengths, buckets=flat, weights=_arrow_list(columns[2])[1])


def _pieces(batches, text_buckets: int | None):
    """Batches of passages; texts, which take many times their bytes while
    they are encoded, in slices of about ``_BATCH_TEXT`` bytes."""
    for batch in batches:
        if batch.num_rows and text_buckets:
            yield from text_slices(batch, 1, _BATCH_TEXT)
        elif batch.num_rows:
            yield batch


def best_of(prep, batches, kind: str, k: int, exclude_self: bool, text_buckets: int | None = None):
    """Exact top-k rows of a question block over Arrow batches of passages
    (id, then vector columns or text)."""
    bests: list[Best] = []
    if exclude_self:
        asked, first = np.unique(prep["ids"], return_index=True)
    for batch in _pieces(batches, text_buckets):
        cids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
        own = None
        if exclude_self and len(asked):
            at = np.minimum(np.searchsorted(asked, cids), len(asked) - 1)
            own = np.where(asked[at] == cids, first[at], -1)
        score_and_select(prep, cids, _block_from_arrow(batch, kind, text_buckets), kind, bests, k, own)
    frames = [f for f in (b.hits() for b in bests) if f is not None]
    if frames:
        yield pa.RecordBatch.from_pandas(merge_top_k(frames, k), preserve_index=False)


def _question_bytes(q: DataFrame, kind: str):
    """Bytes that a question takes in a block: its id and its vector."""
    key = F.octet_length(F.col(q.columns[0]).cast("string")) + 24
    return key + F.size(q.columns[1]) * (8 if kind == "dense" else 16)


def _one_block(q: DataFrame, corpus: DataFrame, kind: str, k: int, exclude_self: bool, schema: str,
               text_buckets: int | None) -> DataFrame:
    """Candidates of questions that fit one block: a broadcast, one scan."""
    data = q.sparkSession.sparkContext.broadcast(_prepared(q.toArrow(), kind))
    return corpus.mapInArrow(lambda batches: best_of(data.value, batches, kind, k, exclude_self, text_buckets), schema)


def cell_shape(spark, weight: int, groups: int) -> tuple[int, int]:
    """Rows and columns of a grid whose cells hold ``CELL_BYTES`` of questions
    (at most ``groups`` rows).  Questions are copied once per column and the
    corpus once per row, so there are no more cells than four for each core."""
    rows = max(1, min(groups, math.ceil(weight / CELL_BYTES)))
    wanted = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows, max(1, -(-wanted // rows))


def _grid(q: DataFrame, corpus: DataFrame, kind: str, k: int, exclude_self: bool, schema: str, rows: int, columns: int,
          text_buckets: int | None) -> DataFrame:
    """Candidates of any number of questions: question groups by corpus
    columns, a task each."""
    vectors = _vector_cols(kind)
    left = q.select(*[F.col(c).alias(f"q{i}") for i, c in enumerate(q.columns)])
    right = corpus.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(corpus.columns)])
    names = right.columns

    def work(table, rights):
        prep = _prepared(table.select([f"q{i}" for i in range(1 + len(vectors))]), kind)
        yield from best_of(prep, (r.select(names) for r in rights), kind, k, exclude_self, text_buckets)

    met = grid(left, right, F.col("q0"), F.col("c0"), rows, columns)
    return met.mapInArrow(lambda batches: cells(batches, work), schema)


def search(questions: DataFrame, corpus: DataFrame, k: int = 5, *, kind: str = "dense",
           question_id: str = "query_id", corpus_id: str = "doc_id", exclude_self: bool = False,
           block_bytes: int = BLOCK_BYTES, corpus_text: str | None = None,
           buckets: int | None = None, scan_tasks: int | None = None) -> DataFrame:
    """Exact top-k: ``query_id, hit_id, score double (6 digits), rank int``.

    ``questions`` and ``corpus`` carry an id column and the vector columns of
    ``kind`` (``dense``: ``embedding``; ``sparse``: ``buckets, weights``).
    With ``corpus_text`` the corpus carries raw text instead of vectors; it
    is encoded by the default encoder (``buckets``): inside the scoring task
    where questions are one group, else once, before the grid.  Only the
    question side runs while the plan is built.  The corpus is scored by at
    most ``scan_tasks`` tasks (default: four for each core of the cluster)."""
    if k < 1:
        raise ValueError("k must be at least 1")
    vcols = _vector_cols(kind)
    q = questions.select(question_id, *vcols).filter(
        F.col(question_id).isNotNull() & F.col(vcols[0]).isNotNull())
    if corpus_text is not None and kind != "sparse":
        raise ValueError("raw-text corpora are encoded into sparse vectors")
    text_buckets = None
    if corpus_text is not None:
        from quarry.functions.vectors import DEFAULT_BUCKETS

        text_buckets = buckets or DEFAULT_BUCKETS
        c = corpus.select(corpus_id, F.col(corpus_text).cast("string").alias("text")).filter(F.col(corpus_id).isNotNull())
    else:
        c = corpus.select(corpus_id, *vcols).filter(
            F.col(corpus_id).isNotNull() & F.col(vcols[0]).isNotNull())
    spark = questions.sparkSession
    schema = _out_schema(q, c, question_id, corpus_id)
    q = materialize(q)
    weight = q.agg(F.sum(_question_bytes(q, kind))).first()[0]
    if not weight:
        return _rank(spark.createDataFrame([], schema), k)
    groups = math.ceil(weight / block_bytes)
    if groups == 1:
        c = c.coalesce(scan_tasks or 4 * spark.sparkContext.defaultParallelism)
        return _rank(_one_block(q, c, kind, k, exclude_self, schema, text_buckets), k)
    rows, columns = cell_shape(spark, weight, groups)
    if text_buckets and rows > 1:  # texts are smaller than their vectors: one row encodes them in its cells
        from quarry.operators.embed import hashed_vectors

        c, text_buckets = hashed_vectors(c, "text", keep=[corpus_id], buckets=text_buckets), None
    return _rank(_grid(q, c, kind, k, exclude_self, schema, rows, columns, text_buckets), k)
