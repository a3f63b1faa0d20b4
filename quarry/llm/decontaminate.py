"""Benchmark decontamination: n-gram seeds, then local alignment.

Every run of ``seed_words`` words of a test item is a seed.  One scan of the
documents finds the seeds in them and gathers hits of one item that lie close
together into a passage, with a margin of the item's length around it.  A passage
goes on if it holds enough of the item's words, in any order, to reach
``min_score``: an alignment matches no more words than both have in common,
so nothing that could score is left out, however often it or its seeds
occur, and frequent phrases alone leave no rows.  Smith-Waterman over words
then scores how much of the item the passage holds, with mismatches and gaps,
and passages of ``min_score`` or more are leaks.  Equal passages are aligned
once.  A copy that keeps no run of ``seed_words`` words of its item is not
found.

The items are taken in blocks of at most ``block_bytes`` of seeds, each
block broadcast and met by one scan, so any number of items has bounded
memory.

Null or empty texts and items without words match nothing; an item shorter
than a seed is its own seed and must occur whole.  Items with equal id are
one item with several texts.  Repeated documents are each reported.  Null
document ids are reported with a null id; null item ids are skipped.  Empty
tables give an empty result; columns besides id and text are not read.
"""
from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import slices, text_buffer
from quarry.llm.words import Lookup, mix, shingle_hashes, word_hashes, word_spans
from quarry.session import materialize

SEED_WORDS = 3
CHUNK_WORDS = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1


class Items:
    """The seeds of a block of test items: hash -> rows of (item, offset)."""

    def __init__(self, ids: list, texts: list[str], seed_words: int):
        blobs = [t.encode() for t in texts]
        off = np.concatenate([[0], np.cumsum([len(b) for b in blobs])])
        buf = np.frombuffer(b"".join(blobs), np.uint8)
        s, e, woff = word_spans(buf, off)
        self.words = word_hashes(buf, s, e)
        self.woff, self.ids = woff, ids
        hashes, soff = shingle_hashes(self.words, woff, seed_words)
        item = np.repeat(np.arange(len(ids)), np.diff(soff))
        place = np.arange(len(hashes)) - soff[item]
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = item[order], place[order]
        seeds, first = np.unique(hashes[order], return_index=True)
        self.seeds, self.first = seeds, np.append(first, len(order))
        self.find = Lookup(seeds)
        self.size = np.diff(woff)
        own = np.repeat(np.arange(len(ids)), self.size)
        pairs, self.times = np.unique(_pair(own, self.words), return_counts=True)
        self.find_word = Lookup(pairs)
        self.short = np.unique(self.size[(self.size > 0) & (self.size < seed_words)])

    def shared(self, words: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many words each passage ``words[lo:hi]`` has in common with its
        item, a repeated word as often as both hold it."""
        out = np.zeros(len(item), np.int64)
        ends = np.cumsum(hi - lo)
        a = 0
        while a < len(item):  # so many passages at once that their words stay about a chunk
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK_WORDS, "right")))
            row, at = _ranges(lo[a:b], hi[a:b])
            word = self.find_word.find(_pair(item[a:b][row], words[at]))
            known = word >= 0
            key, n = np.unique(row[known] * len(self.times) + word[known], return_counts=True)
            out[a:b] = np.bincount(key // max(1, len(self.times)), np.minimum(
                n, self.times[key % max(1, len(self.times))]), b - a)
            a = b
        return out

    def hits(self, words: np.ndarray, woff: np.ndarray, seed_words: int):
        """Word position, seed and length of every seed in the rows' words."""
        out = []
        for k in [seed_words, *self.short.tolist()]:
            if k == seed_words:
                hashes, soff = shingle_hashes(words, woff, k)
                row = np.repeat(np.arange(len(woff) - 1), np.diff(soff))
                at = np.arange(len(hashes)) - soff[row] + woff[row]
            else:  # runs of a short item's length, hashed as a row of that length
                at = np.arange(len(words))
                row = np.searchsorted(woff, at, "right") - 1
                at = at[at + k <= woff[row + 1]]
                flat = (at[:, None] + np.arange(k)).ravel()
                hashes, _ = shingle_hashes(words[flat], np.arange(len(at) + 1) * k, seed_words)
            seed = self.find.find(hashes)
            hit = seed >= 0
            out.append((at[hit], seed[hit]))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _pair(item: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A key of an item and a word."""
    return mix(words + mix(item.astype(np.uint64) + np.uint64(1)))


_ITEMS: dict[str, Items] = {}


def _items(key: str, data, seed_words: int) -> Items:
    if key not in _ITEMS:
        _ITEMS.clear()
        _ITEMS[key] = Items(*data.value, seed_words)
    return _ITEMS[key]


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and members of ranges ``first..last - 1``, one after another."""
    n = last - first
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - (np.cumsum(n) - n)[row] + first[row]


PASSAGE = "item int, words binary, start int, stop int"


def passages(docs: DataFrame, data, seed_words: int, text_col: str, id_col: str, min_score: float) -> DataFrame:
    """``doc, item, words, start, stop``: one row for each stretch of a
    document that holds seeds of an item and enough of its words to reach
    ``min_score``; ``words`` are hashes with a margin."""
    key = uuid.uuid4().hex
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        items = _items(key, data, seed_words)
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            for a, b in slices(off):
                s, e, woff = word_spans(buf[off[a]:off[b]], off[a:b + 1] - off[a])
                words = word_hashes(buf[off[a]:off[b]], s, e)
                at, seed = items.hits(words, woff, seed_words)
                hit, entry = _ranges(items.first[seed], items.first[seed + 1])
                at, seed = at[hit], seed[hit]
                item = items.item[entry]
                row = np.searchsorted(woff, at, "right") - 1
                order = np.lexsort((at, item, row))
                at, item, row = at[order], item[order], row[order]
                if len(at) == 0:
                    continue
                size = items.size[item]
                new = np.ones(len(at), bool)
                new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > size[1:])
                cuts = np.flatnonzero(new)
                ends = np.append(cuts[1:], len(at))
                lo = np.maximum(woff[row[cuts]], at[cuts] - size[cuts])
                hi = np.minimum(woff[row[cuts] + 1], at[ends - 1] + size[cuts] + seed_words)
                able = items.shared(words, item[cuts], lo, hi) >= min_score * size[cuts] - 1e-9
                cuts, lo, hi = cuts[able], lo[able], hi[able]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(row[cuts] + a)), pa.array(item[cuts].astype(np.int32)),
                    pa.array([words[x:y].tobytes() for x, y in zip(lo, hi)], pa.binary()),
                    pa.array((lo - woff[row[cuts]]).astype(np.int32)),
                    pa.array((hi - woff[row[cuts]]).astype(np.int32))],
                    names=["doc", "item", "words", "start", "stop"])

    return (docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
            .mapInArrow(run, f"doc {id_type}, {PASSAGE}"))


def align(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each pair of word sequences; all pairs
    advance together, one anti-diagonal at a time."""
    n, m = max(map(len, a), default=0), max(map(len, b), default=0)
    rows = len(a)
    x = np.zeros((rows, n), np.uint64)
    y = np.ones((rows, m), np.uint64)
    xs, ys = np.zeros((rows, n), bool), np.zeros((rows, m), bool)
    for i, (p, q) in enumerate(zip(a, b)):
        x[i, :len(p)], xs[i, :len(p)] = p, True
        y[i, :len(q)], ys[i, :len(q)] = q, True
    best = np.zeros(rows, np.int32)
    before, last = np.zeros((rows, n + 1), np.int32), np.zeros((rows, n + 1), np.int32)
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        j = d - i
        same = (x[:, i] == y[:, j]) & xs[:, i] & ys[:, j]
        now = np.zeros_like(last)
        cell = np.maximum(before[:, i] + np.where(same, MATCH, MISMATCH),
                          np.maximum(last[:, i], last[:, i + 1]) + GAP)
        cell = np.where(xs[:, i] & ys[:, j], np.maximum(cell, 0), 0)
        now[:, i + 1] = cell
        best = np.maximum(best, cell.max(axis=1))
        before, last = last, now
    return best


def scored(rows: DataFrame, data, seed_words: int) -> DataFrame:
    """``item, words, score``: alignment score over the best possible one."""
    key = uuid.uuid4().hex

    def run(batches):
        items = _items(key, data, seed_words)
        for batch in batches:
            item = batch.column("item").to_numpy()
            found = [np.frombuffer(w.as_py(), np.uint64) for w in batch.column("words")]
            own = [items.words[items.woff[i]:items.woff[i + 1]] for i in item]
            score = np.zeros(len(item))
            order = np.argsort([len(f) * len(o) for f, o in zip(found, own)], kind="stable")
            at = 0
            while at < len(order):  # chunks of like size, so padding stays small
                width = len(found[order[at]]) + len(own[order[at]])
                stop = at + 1
                while stop < len(order) and stop - at < 256 and len(found[order[stop]]) + len(own[order[stop]]) <= width * 1.3 + 8:
                    stop += 1
                part = order[at:stop]
                score[part] = align([own[i] for i in part], [found[i] for i in part])
                at = stop
            size = np.array([len(o) for o in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), batch.column("words"), pa.array(score / (MATCH * np.maximum(1, size)))],
                names=["item", "words", "score"])

    return rows.mapInArrow(run, "item int, words binary, score double")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", seed_words: int = SEED_WORDS,
          min_score: float = 0.5, block_bytes: int = 32 << 20) -> DataFrame:
    """One row per contaminated document and test item: ``doc_id, item_id,
    score, start, stop`` (word positions of the best passage with its margin)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").alias("id"), F.col(f"`{item_text_col}`").alias("text")) \
        .filter("id is not null and text is not null")
    weight = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(weight * 16 / block_bytes))  # a seed takes about 16 times its share of text
    id_type = docs.schema[id_col].dataType.simpleString()
    item_type = benchmark.schema[item_col].dataType.simpleString()
    made = []
    for block in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).toArrow()
        ids, texts = mine.column(0).to_pylist(), mine.column(1).to_pylist()
        data = spark.sparkContext.broadcast((ids, texts))
        found = materialize(passages(docs, data, seed_words, text_col, id_col, min_score))
        keyed = found.withColumn("h", F.xxhash64("item", "words"))
        wanted = keyed.select("item", "words").distinct()
        tasks = max(2 * spark.sparkContext.defaultParallelism,
                    int(spark.conf.get("spark.sql.shuffle.partitions")))
        good = materialize(scored(wanted.repartition(tasks), data, seed_words)
                           .filter(F.col("score") >= min_score)
                           .withColumn("h", F.xxhash64("item", "words")))
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {item_type}")
        best = (keyed.select("doc", "item", "h", "start", "stop").join(good.select("item", "h", "score"), ["item", "h"])
                .groupBy("doc", "item").agg(F.max(F.struct("score", "start", "stop")).alias("b")))
        made.append(best.join(names, "item").select(
            F.col("doc").alias("doc_id"), "item_id", "b.score", "b.start", "b.stop"))
    rows = made[0]
    for more in made[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "start", "stop")).alias("b")) \
        .select(F.col("doc_id").cast(id_type).alias("doc_id"), "item_id", "b.score", "b.start", "b.stop")
