"""Hard negatives by maximum inner product: cover trees over candidates.

Vectors are made whole numbers; candidates are dealt by label and a hash to
trees of bounded size.  A tree's points get one more coordinate that makes all
norms equal, so that inner products order points as distances do; in that
space a cover tree is built: a node's children are a net of half its radius,
down to small leaves, and every node knows its covering radius (as an angle).
For a question the radius bounds the inner products of all points below a
node from both sides.  Descent is best-first: the nodes with the highest upper
bounds are opened, nodes wholly above or below the window of allowed scores,
or below the worst hit kept, are skipped, and leaves are verified in whole
numbers.

Anchors and trees meet in a grid of tasks, once for positives and once for
the windows that these leave; each task returns at most k rows a question, and
``row_number`` ranks them.  All anchors meet all trees, as the query set asks;
nothing is broadcast.

Rows without id or label, and vectors that are null, empty or hold null or
non-finite components take no part; vectors of different lengths do not meet.
Rows that share an id are rows of their own (equal scores and ids keep the
order in which the rows were read); a row is never its own positive.  A
positive of negative score has an empty window.  Scores are exact; above 64 bits they saturate.
Other columns are not looked at.  An empty table gives an empty table.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.grid import cells, grid, shape
from quarry.session import materialize

TREE_ROWS = 4096  # points of a tree, about
LEAF = 32  # points of a leaf, at most, if they differ
ANCHORS = 512  # anchors of a grid row, about
OPEN = 8  # nodes opened at once
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, turn: int, labels: int,
                  scale: int) -> DataFrame:
    """``row, id, label, dim, v``: usable rows, each with a number of its own
    that orders equal ids; ``v`` holds whole doubles as bytes."""
    def make(batches):
        for batch in batches:
            blobs = []
            for value in batch.column("x").to_pylist():
                x = np.array(value, np.float64) if value and None not in value else None
                blobs.append(None if x is None or not np.isfinite(x).all() else np.floor(scale * x).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(blobs, pa.binary())],
                                             names=["id", "label", "v"])

    label = F.col(f"`{label_col}`").cast("long")
    rows = (vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.alias("label"),
                           F.col(f"`{vector_col}`").alias("x"))
            .filter("id is not null and label is not null")
            .withColumn("label", F.when(F.col("id") % turn == 0, (F.col("label") + 1) % labels)
                        .otherwise(F.col("label")))
            .mapInArrow(make, "id long, label long, v binary").filter("v is not null")
            .withColumn("dim", (F.octet_length("v") / 8).cast("int")))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()))


class Tree:
    """A cover tree over whole vectors of one label."""

    FIELDS = ("points", "ids", "rows", "centre", "radius", "first", "last", "low", "high")

    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        norm = np.sqrt((points**2).sum(1))
        top = norm.max()
        lift = np.sqrt(np.maximum(0, top**2 - norm**2))
        on = np.concatenate([points, lift[:, None]], axis=1) / (top or 1.0)
        order: list[np.ndarray] = []
        centre, radius, first, last, low, high = [0], [0.0], [0], [0], [0], [0]
        todo, placed = [(0, np.arange(len(points)))], 0
        while todo:
            node, members = todo.pop()
            away = np.sqrt(np.maximum(0, 2 - 2 * (on[members] @ on[centre[node]])))
            reach = float(away.max())
            radius[node] = 2 * math.asin(min(1.0, reach / 2))
            if len(members) <= LEAF or reach < 1e-7:
                order.append(members)
                low[node], high[node] = placed, placed + len(members)
                placed += len(members)
                continue
            first[node] = len(centre)
            rest, own = members, centre[node]  # the node's centre is the first of the net
            while len(rest):
                at = on[rest] @ on[own]
                near = (2 - 2 * at <= (reach / 2) ** 2) | (rest == own)
                todo.append((len(centre), rest[near]))
                for column, value in zip((centre, radius, first, last, low, high), (own, 0.0, 0, 0, 0, 0)):
                    column.append(value)
                rest = rest[~near]
                if len(rest):
                    own = rest[0]
            last[node] = len(centre)
        order_ = np.concatenate(order)
        self.points, self.ids, self.rows = points[order_], ids[order_], rows[order_]
        back = np.empty(len(order_), np.int64)
        back[order_] = np.arange(len(order_))
        self.centre = back[np.array(centre)]
        self.radius = np.array(radius)
        self.first, self.last, self.low, self.high = (np.array(x, np.int64) for x in (first, last, low, high))
        self._norm()

    def _norm(self):
        self.norm = float(np.sqrt((self.points**2).sum(1)).max())
        self.centres = self.points[self.centre]

    def pack(self) -> bytes:
        table = pa.table({"name": list(self.FIELDS), "data": [getattr(self, f).tobytes() for f in self.FIELDS]})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    @classmethod
    def unpack(cls, raw: bytes) -> Tree:
        tree = cls.__new__(cls)
        data = pa.ipc.open_stream(raw).read_all().column("data").to_pylist()
        kinds = (np.float64, np.int64, np.int64, np.int64, np.float64, np.int64, np.int64, np.int64, np.int64)
        for name, blob, kind in zip(cls.FIELDS, data, kinds):
            setattr(tree, name, np.frombuffer(blob, kind))
        tree.points = tree.points.reshape(len(tree.ids), -1)
        tree._norm()
        return tree

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the inner products below each node."""
        most = self.norm * float(np.sqrt((q**2).sum()))
        if not most:
            return np.zeros(len(self.radius)), np.zeros(len(self.radius))
        angle = np.arccos(np.clip(self.centres @ q / most, -1, 1))
        slack = 1e-6 * most + 1e-6
        return (most * np.cos(np.minimum(math.pi, angle + self.radius)) - slack,
                most * np.cos(np.maximum(0, angle - self.radius)) + slack)


def exact_products(points: np.ndarray, q: np.ndarray) -> list | np.ndarray:
    """Inner products of whole numbers: as doubles where these are exact."""
    if points.size and np.abs(points).max() * max(1.0, np.abs(q).max()) * points.shape[1] >= _EXACT:
        whole = [int(x) for x in q.tolist()]
        return np.array([sum(int(x) * y for x, y in zip(p, whole)) for p in points.tolist()], object)
    return (points @ q).astype(np.int64)


class Best:
    """The best ``k`` of (score, id, row), higher scores and smaller ids first."""

    def __init__(self, k: int, low=None, high=None):
        self.k, self.low, self.high, self.hits = k, low, high, []

    def full(self) -> bool:
        return len(self.hits) >= self.k

    def worst(self):
        return self.hits[-1][0] if self.full() else None

    def add(self, scores, ids, rows, but: int):
        use = np.asarray(rows != but)
        if self.high is not None:
            use &= np.asarray(scores <= self.high, bool) & np.asarray(scores >= self.low, bool)
        if self.full():
            use &= np.asarray(scores >= self.worst(), bool)
        use = np.flatnonzero(use)
        found = [(-int(scores[i]), int(ids[i]), int(rows[i])) for i in use]
        old = [(-s, i, r) for s, i, r in self.hits]
        self.hits = [(-s, i, r) for s, i, r in sorted(old + found)[:self.k]]


def descend(tree: Tree, q: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], best: Best, but: int) -> int:
    """Best-first descent; returns the number of points verified."""
    low, high = bounds
    front, seen = np.zeros(1, np.int64), 0
    while len(front):
        if best.high is not None:
            front = front[(high[front] >= best.low) & (low[front] <= best.high)]
        if best.full():
            front = front[high[front] >= best.worst()]
        if not len(front):
            break
        key = high[front] if best.high is None else np.minimum(high[front], float(best.high))
        pick = np.argpartition(-key, OPEN - 1)[:OPEN] if len(front) > OPEN else np.arange(len(front))
        opened = front[pick]
        front = np.delete(front, pick)
        inner = opened[tree.last[opened] > 0]
        leaves = opened[tree.last[opened] == 0]
        if len(leaves):
            at = np.concatenate([np.arange(tree.low[n], tree.high[n]) for n in leaves])
            best.add(exact_products(tree.points[at], q), tree.ids[at], tree.rows[at], but)
            seen += len(at)
        if len(inner):
            front = np.concatenate([front, *[np.arange(tree.first[n], tree.last[n]) for n in inner]])
    return seen


def plant(rows: DataFrame) -> DataFrame:
    """``no, label, dim, tree``: the packed trees of all rows."""
    sizes = rows.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / TREE_ROWS).cast("int").alias("trees"))
    dealt = rows.join(sizes, ["label", "dim"]).withColumn("no", F.pmod(F.xxhash64("row"), "trees").cast("int"))

    def build(batches):
        held, key = [], None

        def made():
            table = pa.Table.from_batches(held)
            ids, numbers = table.column("id").to_numpy(), table.column("row").to_numpy()
            points = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(len(ids), -1)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[2]], pa.int32()), pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()),
                 pa.array([Tree(points, ids, numbers).pack()], pa.binary())], names=["no", "label", "dim", "tree"])

        for batch in batches:
            marks = list(zip(*[batch.column(c).to_pylist() for c in ("label", "dim", "no")]))
            start = 0
            for i in range(1, len(marks) + 1):
                if i == len(marks) or marks[i] != marks[start]:
                    if held and marks[start] != key:
                        yield made()
                        held = []
                    key = marks[start]
                    held.append(batch.slice(start, i - start))
                    start = i
        if held:
            yield made()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(dealt.select("label", "dim", "no", "row", "id", "v")
                       .repartition(n, "label", "dim", "no").sortWithinPartitions("label", "dim", "no")
                       .mapInArrow(build, "no int, label long, dim int, tree binary"))


HITS = "anchor long, anchor_id long, positive long, score long, id long, row long"


def _clip(score: int) -> int:
    return max(-_LONG - 1, min(_LONG, score))


def search(asked: DataFrame, trees: DataFrame, k: int, windows: bool) -> DataFrame:
    """Best ``k`` rows of each question in each task.  ``asked`` has anchors
    (``row, id, label, dim, v``); with ``windows`` also ``positive``, the row
    it asks for, and ``low, high``, and only other labels count; without, only
    the same label."""
    def work(left, rights):
        names = left.column_names
        rows = [dict(zip(names, r)) for r in zip(*[left.column(c).to_pylist() for c in names])]
        by_anchor: dict = {}
        for r in rows:
            by_anchor.setdefault(r["row"], []).append(r)
        best = {(r["row"], r["positive"]): Best(k, r["low"], r["high"]) for r in rows}
        vectors = {a: np.frombuffer(rs[0]["v"], np.float64) for a, rs in by_anchor.items()}
        for batch in rights:
            for label, dim, raw in zip(*[batch.column(c).to_pylist() for c in ("label", "dim", "tree")]):
                tree = Tree.unpack(raw)
                for anchor, rs in by_anchor.items():
                    if rs[0]["dim"] != dim or (rs[0]["label"] == label) == windows:
                        continue
                    bounds = tree.bounds(vectors[anchor])
                    for r in rs:
                        descend(tree, vectors[anchor], bounds, best[r["row"], r["positive"]], r["row"])
        ids = {r["row"]: r["id"] for r in rows}
        out = [(a, ids[a], p, _clip(s), i, n) for (a, p), b in best.items() for s, i, n in b.hits]
        if out:
            kinds = [pa.int64()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                             names=[f.split()[0] for f in HITS.split(", ")])

    spark = asked.sparkSession
    rows, columns = shape(spark, max(1, math.ceil(asked.select("row").distinct().count() / ANCHORS)), trees.count())
    left = asked.select("row", "id", "dim", "label", "v", "positive", "low", "high")
    met = grid(left, trees.select("label", "dim", "no", "tree"), F.col("row"), F.struct("label", "dim", "no"),
               rows, columns)
    return met.mapInArrow(lambda batches: cells(batches, work), HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), F.asc("id"), F.asc("row"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label",
                   vector_col: str = "embedding", every: int = 100, positives: int = 5, negatives: int = 5,
                   low_percent: int = 80, high_percent: int = 100, turn: int = 7, labels: int = 10,
                   scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``: for every anchor (id divisible by ``every``) and each of
    its best ``positives`` of the same label, the best ``negatives`` of other
    labels that score ``low_percent`` to ``high_percent`` of the positive.
    Labels of ids divisible by ``turn`` first become the next of ``labels``."""
    rows = whole_vectors(vectors, id_col, label_col, vector_col, turn, labels, scale)
    trees = plant(rows)
    anchors = rows.filter(F.col("id") % every == 0)
    none = F.lit(None).cast("long")
    same = _ranked(search(anchors.withColumns({"positive": none, "low": none, "high": none}), trees, positives, False),
                   positives)
    same = materialize(same.select(F.col("anchor").alias("row"), F.col("row").alias("positive"),
                                   F.col("id").alias("positive_id"), "score"))
    low = F.ceil(F.col("score").cast("decimal(19,0)") * low_percent / F.lit(100)).cast("long")
    high = F.floor(F.col("score").cast("decimal(19,0)") * high_percent / F.lit(100)).cast("long")
    asked = (anchors.join(same, "row").withColumns({"low": low, "high": high}).filter("low <= high"))
    found = _ranked(search(asked, trees, negatives, True), negatives)
    return (found.join(same.withColumnRenamed("row", "anchor").withColumnRenamed("score", "positive_score"),
                       ["anchor", "positive"])
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
