"""Kneser-Ney models over byte n-grams, counted and estimated as tables.

An n-gram of k <= 6 bytes is one long: its order in the top byte, its bytes
below, the last byte lowest.  Counting packs whole slices of text with numpy
and sums distinct n-grams inside the slice before the shuffle; everything
after that (continuation counts, discounts, interpolation) is joins and
aggregates over n-gram tables.  Several classes are estimated side by side in
one table; orders up to ``shared`` use the counts of all classes together.

Scoring looks every position up at the highest order and falls back order by
order.  The model is broadcast in parts, as many as make ``max_entries`` rows
(16 bytes each) the mean: an n-gram lies in the part given by the two bytes
before its last one, and so do all contexts and shorter n-grams its score
needs, so each part scores its positions completely and the parts' sums add
up.  This is no strict bound: a row may lie in two parts, as an n-gram and as
a context, and the n-grams of one pair of bytes stay together.
"""
from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField

from quarry.llm.batches import per_text
from quarry.llm.words import LOWER, Lookup
from quarry.session import materialize

ORDER = 6
MAX_ENTRIES = 4_000_000


def byte_windows(buf: np.ndarray, off: np.ndarray, order: int, lower: bool) -> np.ndarray:
    """The packed window of ``order`` bytes that ends at each byte; bytes
    before a text's start are zero."""
    size = np.diff(off)
    pad = order - 1
    place = np.arange(len(buf)) + np.repeat(np.arange(1, len(size) + 1) * pad, size)
    wide = np.zeros(len(buf) + pad * len(size), np.uint8)
    wide[place] = LOWER[buf] if lower else buf
    code = np.zeros(len(buf), np.uint64)
    for j in range(order):
        code |= wide[place - j].astype(np.uint64) << np.uint64(8 * j)
    return code


def _tag(order: int) -> int:
    return order << 56


def count_windows(docs: DataFrame, text_col: str, class_col: str, classes: int,
                  order: int = ORDER, lower: bool = False) -> DataFrame:
    """``code, n0, n1, ...``: how often each window of ``order`` bytes occurs
    in the texts of each class (``class_col`` holds 0, 1, ...)."""
    lists = ArrayType(LongType())
    fields = [StructField("code", lists), StructField("n", lists)]

    def count(buf, off):
        codes, n = np.unique(byte_windows(buf, off, order, lower), return_counts=True)
        first = np.concatenate([[0], np.full(len(off) - 1, len(codes))]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(first), pa.array(x.astype(np.int64)))
                for x in (codes | np.uint64(_tag(order)), n)]

    made = [per_text(docs.filter(F.col(class_col) == k), text_col, [], fields, count)
            .select(F.explode(F.arrays_zip("code", "n")).alias("x"), F.lit(k).alias("k"))
            for k in range(classes)]
    rows = made[0]
    for more in made[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(F.col("x.code").alias("code")).agg(*[
        F.sum(F.when(F.col("k") == k, F.col("x.n")).otherwise(0)).alias(f"n{k}") for k in range(classes)])


def _suffix(code: Column, order: int) -> Column:
    return code.bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1)).bitwiseOR(F.lit(_tag(order - 1)))


def _context(code: Column, order: int) -> Column:
    bytes_ = code.bitwiseAND(F.lit((1 << (8 * order)) - 1))
    return F.shiftright(bytes_, 8).bitwiseOR(F.lit(_tag(order - 1)))


def _discounts(table: DataFrame, k: int) -> list[float]:
    """The three discounts of modified Kneser-Ney from counts of counts, each
    kept between 0 and its count."""
    row = table.agg(*[F.sum((F.col(f"n{k}") == i).cast("long")).alias(f"c{i}") for i in (1, 2, 3, 4)]).first()
    c = [float(x or 0) for x in row]
    if not c[0] or not c[1]:
        return [0.5, 0.5, 0.5]
    y = c[0] / (c[0] + 2 * c[1])
    raw = [i - (i + 1) * y * (c[i] / c[i - 1] if c[i - 1] else 0.0) for i in (1, 2, 3)]
    return [min(max(d, 0.05), i - 0.05) for d, i in zip(raw, (1, 2, 3))]


def estimate(windows: DataFrame, classes: int, order: int = ORDER, shared: int = 0) -> DataFrame:
    """``code, value, back``: for a known n-gram the log-probability of its
    last byte after the others (with two classes, that of class 1 less that
    of class 0), and as a context the log backoff weight (again a
    difference).  One row per n-gram of every order; order 0 is the row of
    the empty context."""
    levels = {order: materialize(windows)}
    for k in range(order - 1, 0, -1):
        wider = levels[k + 1]
        agg = [F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"n{c}") for c in range(classes)]
        if k <= shared:
            every = F.lit(False)
            for c in range(classes):
                every = every | (F.col(f"n{c}") > 0)
            agg = [F.sum(every.cast("long")).alias(f"n{c}") for c in range(classes)]
        levels[k] = materialize(wider.groupBy(_suffix(F.col("code"), k + 1).alias("code")).agg(*agg))

    below, out = None, []
    for k in range(1, order + 1):
        d = [_discounts(levels[k], c) for c in range(classes)]
        rows = levels[k].withColumn("h", _context(F.col("code"), k))
        sums = []
        for c in range(classes):
            n = F.col(f"n{c}")
            off = F.when(n >= 3, d[c][2]).when(n == 2, d[c][1]).when(n == 1, d[c][0]).otherwise(0.0)
            rows = rows.withColumn(f"d{c}", off)
            sums += [F.sum(n).alias(f"t{c}"), F.sum(f"d{c}").alias(f"g{c}")]
        contexts = rows.groupBy("h").agg(*sums)
        for c in range(classes):
            contexts = contexts.withColumn(
                f"g{c}", F.when(F.col(f"t{c}") > 0, F.col(f"g{c}") / F.col(f"t{c}")).otherwise(1.0))
        contexts = materialize(contexts)
        rows = rows.join(contexts, "h")
        if below is not None:
            rows = rows.join(below, _suffix(F.col("code"), k) == F.col("s")).drop("s")
        probs = []
        for c in range(classes):
            own = F.when(F.col(f"t{c}") > 0, (F.col(f"n{c}") - F.col(f"d{c}")) / F.col(f"t{c}")).otherwise(0.0)
            lower = F.col(f"q{c}") if below is not None else F.lit(1.0 / 256)
            probs.append((own + F.col(f"g{c}") * lower).alias(f"p{c}"))
        rows = materialize(rows.select("code", *probs))
        below = rows.select(F.col("code").alias("s"), *[F.col(f"p{c}").alias(f"q{c}") for c in range(classes)])
        log = [F.log(f"p{c}") for c in range(classes)]
        bow = [F.log(f"g{c}") for c in range(classes)]
        value, back = (log[0], bow[0]) if classes == 1 else (log[1] - log[0], bow[1] - bow[0])
        out.append((rows.select("code", value.alias("value")), contexts.select(
            F.col("h").alias("code"), back.alias("back"))))
    grams = out[0][0]
    backs = out[0][1]
    for g, b in out[1:]:
        grams, backs = grams.unionByName(g), backs.unionByName(b)
    return materialize(grams.join(backs, "code", "full").fillna({"back": 0.0}))


def _owner(pair, passes: int):
    """The part, of ``passes``, of a pair of bytes: the same arithmetic for
    columns and for arrays."""
    return (pair * 40503) % 65536 % passes


class Scorer:
    """One broadcast part of a model, looked up with whole arrays."""

    def __init__(self, codes, values, backs, order: int, unseen: float):
        self.table, self.order, self.unseen = Lookup(codes), order, unseen
        self.values, self.backs = values, np.append(backs, 0.0)  # row -1, no such context: weight 1
        self.known = ~np.isnan(values)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        total = np.zeros(len(codes))
        left = np.arange(len(codes))
        for k in range(self.order, 0, -1):
            bytes_ = codes[left] & np.uint64((1 << (8 * k)) - 1)
            row = self.table.find(bytes_ | np.uint64(_tag(k)))
            hit = row >= 0
            hit[hit] = self.known[row[hit]]
            total[left[hit]] += self.values[row[hit]]
            left, bytes_ = left[~hit], bytes_[~hit]
            if len(left) == 0:
                return total
            context = self.table.find((bytes_ >> np.uint64(8)) | np.uint64(_tag(k - 1)))
            total[left] += self.backs[context]
        total[left] += self.unseen
        return total


def score(docs: DataFrame, model: DataFrame, text_col: str, keep: list[str], classes: int,
          order: int = ORDER, lower: bool = False, floors: tuple[float, ...] = (0.0,),
          max_entries: int = MAX_ENTRIES) -> DataFrame:
    """``keep..., __total0, __total1, ... double, __bytes long``: the sum of the
    model's values over all bytes of each text, one sum for each of
    ``floors``, which leaves out values nearer to 0 than it.  One row for each
    row of ``docs``, whatever ``keep`` holds.  With a model of one part this
    is one narrow pass; with more, the rows are written once with a key of
    their own, each part is a pass over them, and the sums are added by key."""
    spark = docs.sparkSession
    unseen = math.log(1.0 / 256) if classes == 1 else 0.0
    passes = max(1, math.ceil(model.count() / max_entries))
    k = F.shiftrightunsigned("code", 56)
    pair = F.lit(0xFFFF)
    parts = (model.withColumn("as_gram", _owner(F.shiftright("code", 8).bitwiseAND(pair), passes))
             .withColumn("as_context", _owner(F.col("code").bitwiseAND(pair), passes)))
    totals = [f"__total{i}" for i in range(len(floors))]
    fields = [StructField(t, DoubleType()) for t in totals] + [StructField("__bytes", LongType())]
    keyed, own = docs, keep
    if passes > 1:
        keyed = materialize(docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, text_col])],
                                        F.monotonically_increasing_id().alias("__row")))
        own = ["__row"]
    made = []
    for p in range(passes):
        mine = parts.filter((k < 3) | (F.col("as_gram") == p) | (F.col("as_context") == p))
        rows = mine.select("code", F.col("value").cast("float"), F.col("back").cast("float")).toArrow()
        data = spark.sparkContext.broadcast(tuple(
            rows.column(i).to_numpy(zero_copy_only=False).astype(t)
            for i, t in enumerate((np.uint64, np.float32, np.float32))))
        made.append(per_text(keyed, text_col, own, fields, _summing(data, order, unseen, lower, floors, p, passes)))
    if passes == 1:
        return made[0]
    rows = made[0]
    for more in made[1:]:
        rows = rows.unionByName(more)
    sums = rows.groupBy("__row").agg(*[F.sum(t).alias(t) for t in totals], F.max("__bytes").alias("__bytes"))
    return (keyed.select(*[f"`{c}`" for c in keep], "__row").join(sums, "__row")
            .select(*[f"`{c}`" for c in keep], *totals, "__bytes"))


_SCORERS: dict[str, Scorer] = {}


def _scorer(key: str, data, order: int, unseen: float) -> Scorer:
    """The part's lookup table, built once per Python worker."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(*data.value, order, unseen)
    return _SCORERS[key]


def _summing(data, order, unseen, lower, floors, p, passes):
    key = uuid.uuid4().hex

    def run(buf, off):
        codes = byte_windows(buf, off, order, lower)
        mine = slice(None)
        if passes > 1:
            mine = _owner((codes >> np.uint64(8)).astype(np.int64) & 0xFFFF, passes) == p
        values = np.zeros(len(codes))
        values[mine] = _scorer(key, data, order, unseen)(codes[mine])
        made = []
        for floor in floors:
            sums = np.concatenate([[0.0], np.cumsum(np.where(np.abs(values) < floor, 0.0, values))])
            made.append(sums[off[1:]] - sums[off[:-1]])
        return made + [np.diff(off)]

    return run
