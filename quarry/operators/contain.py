"""Which long texts contain which short texts, exactly, without pairing
every needle with every haystack, in time linear in the haystacks.

At a position of a haystack the longest needle that starts there is found by a
binary search over the distinct needle lengths: every needle leaves a hash of
its beginnings at the lengths that the search visits on its way to it, each
with the longest needle that is a beginning of it.  A step is one table lookup
for all open positions of a slice at once, so needles that share beginnings
cost no more than others.  The shorter needles at a position are beginnings
of the longest one and follow from it.  Positions are open where the first
bytes (up to 8) are those of some needle.  What is found is compared in full
once for each text and needle.

Needles that fit one block of ``block_bytes`` are broadcast and met by one
scan, and texts stay in the partition that read them; more of them meet the
haystacks in a grid of tasks.  UTF-8 bytes are compared, which agrees with
comparing characters.  Beginnings are told apart by 64-bit hashes.
"""
from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.grid import cells, grid, shape
from quarry.operators.workers import kept_last
from quarry.session import materialize

HEAD = 8
SLICE = 1 << 20  # bytes of haystacks searched at once
_BYTE = np.random.default_rng(41).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps)


class Hashed:
    """Bytes with a hash of any range of them."""

    def __init__(self, raw: np.ndarray):
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _powers(_P, len(raw)), out=self.total[1:])
        self.down = _powers(_P_INV, len(raw) + 1)

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        x = (self.total[start + size] - self.total[start]) * self.down[start] + size.astype(np.uint64) * _BYTE[0]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class Needles:
    """A block of needles (distinct, not empty) made ready for the search."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.sizes = np.unique(np.array([len(t) for t in texts], np.int64))
        heads: dict[int, set[int]] = {}
        for t in texts:
            heads.setdefault(min(HEAD, len(t)), set()).add(int.from_bytes(t[:HEAD], "little"))
        self.heads = {n: np.array(sorted(h), np.uint64) for n, h in heads.items()}
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        whole = Hashed(np.frombuffer(b"".join(texts), np.uint8))
        # Beginnings that the search meets on its way to each needle.
        begin: list[tuple[int, int]] = []
        where = np.searchsorted(self.sizes, np.diff(off))
        for i, at in enumerate(where.tolist()):
            lo, hi = 0, len(self.sizes) - 1
            while lo <= hi:
                mid = (lo + hi) // 2
                if mid <= at:
                    begin.append((i, int(self.sizes[mid])))
                if mid == at:
                    break
                lo, hi = (mid + 1, hi) if mid < at else (lo, mid - 1)
        owner, size = (np.array(x, np.int64) for x in (zip(*begin) if begin else ((), ())))
        keys, first = np.unique(whole.of(off[owner], size), return_index=True)
        self.keys, owner, size = keys, owner[first], size[first]
        # In order of the bytes, the needles that begin a string lie on a stack.
        todo = sorted([(t, 0, i) for i, t in enumerate(texts)]
                      + [(texts[o][:s], 1, j) for j, (o, s) in enumerate(zip(owner.tolist(), size.tolist()))])
        self.longest = np.full(len(keys), -1, np.int64)  # of each key: the longest needle that begins it
        self.shorter = np.full(len(texts), -1, np.int64)  # of each needle: the next shorter one that begins it
        stack: list[int] = []
        for text, kind, i in todo:
            while stack and not text.startswith(texts[stack[-1]]):
                stack.pop()
            if kind:
                self.longest[i] = stack[-1] if stack else -1
            else:
                self.shorter[i] = stack[-1] if stack else -1
                stack.append(i)

    def open_positions(self, raw: np.ndarray) -> np.ndarray:
        """Positions whose first bytes some needle starts with."""
        hit = np.zeros(len(raw), bool)
        code = np.zeros(len(raw), np.uint64)
        for n in range(1, min(HEAD, len(raw)) + 1):
            code = code[:len(raw) - n + 1] | raw[n - 1:].astype(np.uint64) << np.uint64(8 * (n - 1))
            heads = self.heads.get(n)
            if heads is not None:
                hit[:len(code)] |= heads[np.minimum(np.searchsorted(heads, code), len(heads) - 1)] == code
        return np.flatnonzero(hit)

    def search(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and needle of every (text, needle) pair where the text holds
        the needle; ``off`` are the ends of the texts in ``raw``."""
        at = self.open_positions(raw)
        if len(at) == 0 or len(self.keys) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = Hashed(raw)
        row = np.searchsorted(off, at, "right") - 1
        room = off[row + 1] - at
        best = np.full(len(at), -1, np.int64)
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.sizes) - 1)
        todo = np.arange(len(at))
        while len(todo):
            mid = (lo[todo] + hi[todo]) // 2
            size = self.sizes[mid]
            fits = size <= room[todo]
            key = text.of(at[todo], np.where(fits, size, 0))
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = fits & (self.keys[slot] == key)
            known = found & (self.longest[slot] >= 0)
            best[todo[known]] = self.longest[slot[known]]
            lo[todo[found]] = mid[found] + 1
            hi[todo[~found]] = mid[~found] - 1
            todo = todo[lo[todo] <= hi[todo]]
        use = best >= 0
        pair = np.unique(row[use] * len(self.texts) + best[use], return_index=True)
        pairs, place = pair[0], at[use][pair[1]]
        seen: dict[int, int] = dict(zip(pairs.tolist(), place.tolist()))
        todo_ = list(seen.items())
        for code, p in todo_:  # needles that begin a found one are there, too
            r, i = divmod(code, len(self.texts))
            i = int(self.shorter[i])
            while i >= 0 and r * len(self.texts) + i not in seen:
                seen[r * len(self.texts) + i] = p
                i = int(self.shorter[i])
        out = sorted(code for code, p in seen.items() if self._holds(raw, p, code % len(self.texts)))
        rows = np.array(out, np.int64)
        return rows // len(self.texts), rows % len(self.texts)

    def _holds(self, raw: np.ndarray, p: int, i: int) -> bool:
        return raw[p:p + len(self.texts[i])].tobytes() == self.texts[i]


def _scan(block: Needles, batches):
    """Hits of Arrow batches (id, text)."""
    for batch in batches:
        rows, texts = [], []
        lo = 0
        data = [t.as_buffer() for t in batch.column(1)]
        while lo < len(data):
            hi, size = lo, 0
            while hi < len(data) and (hi == lo or size + data[hi].size <= SLICE):
                size, hi = size + data[hi].size, hi + 1
            off = np.concatenate([[0], np.cumsum([d.size for d in data[lo:hi]])]).astype(np.int64)
            raw = np.frombuffer(b"".join(data[lo:hi]), np.uint8)
            r, n = block.search(raw, off)
            rows += (r + lo).tolist()
            texts += [block.texts[i].decode("utf-8") for i in n.tolist()]
            lo = hi
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(texts, pa.string())], names=["_hid", "_nt"])


def containing(needles: DataFrame, haystacks: DataFrame, needle_id: str = "needle_id",
               needle_text: str = "needle", hay_id: str = "doc_id", hay_text: str = "text",
               block_bytes: int = 16 << 20) -> DataFrame:
    """``needle_id, doc_id`` pairs where the haystack text contains the needle
    text, one per pair of rows.  Null and empty texts match nothing; ids may
    have any type."""
    spark = haystacks.sparkSession
    texts = (needles.select(F.col(needle_text).alias("_nt")).filter(F.length("_nt") > 0)
             .distinct())
    weight = texts.agg(F.sum(F.octet_length("_nt") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(weight / block_bytes))
    src = haystacks.select(F.col(hay_id).alias("_hid"), F.col(hay_text).alias("_ht")).filter(F.length("_ht") > 0)
    schema = f"_hid {haystacks.schema[hay_id].dataType.simpleString()}, _nt string"
    if blocks == 1:
        data = spark.sparkContext.broadcast([t.encode("utf-8") for t in texts.toArrow().column(0).to_pylist()])
        key = uuid.uuid4().hex

        def run(batches):
            yield from _scan(kept_last("needles", key, lambda: Needles(data.value)), batches)

        hits = src.mapInArrow(run, schema)
    else:
        def work(table, rights):
            block = Needles([t.encode("utf-8") for t in table.column("_nt").to_pylist()])
            yield from _scan(block, (r.select(["_hid", "_ht"]) for r in rights))

        rows, columns = shape(spark, blocks, 1 << 30)
        met = grid(materialize(texts), src, F.col("_nt"), F.struct("_hid", "_ht"), rows, columns)
        hits = met.mapInArrow(lambda batches: cells(batches, work), schema)
    named = needles.select(F.col(needle_id).alias("_nid"), F.col(needle_text).alias("_nt"))
    return hits.join(named, "_nt").select(F.col("_nid").alias(needle_id), F.col("_hid").alias(hay_id))
