"""Repeated passages by Relative Lempel-Ziv parsing against reference blocks.

1. Anchors.  Of the eight-word runs in a window of 20 words the one with the
   smallest hash is its anchor, so equal windows have equal anchors.  Anchors
   that occur once rule their windows out; the others, as a bit filter of
   bounded size, cut documents down to stretches that may hold a repeat.
2. Blocks.  The stretches, in document order by a range partitioning, form
   reference blocks of bounded bytes.  Every block is indexed by the hashes of
   its windows, and the index is shared out by hash: each distinct window is
   told the first block that holds it.
3. Parsing.  Neighbouring windows with the same first block are a region.  A
   region travels to that block and is parsed greedily against it: the index
   gives the earliest place of the window at hand, words are compared from
   there on as far as they agree (and the bytes of the whole factor), and the
   parse goes on with the windows that straddle the factor's end.  Factors of
   a window or more are duplicate spans.  Regions of equal text leave a block
   once; a block that many regions need is copied, so that a task has a
   bounded number of bytes to parse.
4. Words under spans go.  Only documents with spans are moved for that.

Words are parted by 0x20 and 0x09-0x0D and taken unchanged from whole texts.
Null texts have no words.  Documents are ordered by id (null last), and rows
that share an id by a hash of their text; of rows equal in both, one is kept
as a document and the others repeat it.  Texts shorter than a window keep all
words.  An empty table gives an empty table; other columns are not looked at.
A repeat could be missed only where 48-bit window hashes of one part of the
index collide (under 1e-7 per window); what is removed was compared in full.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import slices, text_buffer
from quarry.llm.packed import bit_filter, groups, in_filter, joined, pack
from quarry.llm.words import mix, word_hashes, word_spans
from quarry.session import materialize

SLICE = 4 << 20  # bytes of text looked at at once
BLOCK = 4 << 20  # bytes of a reference block, about
PART = 1_500_000  # windows that share a part of an index
LOAD = 1 << 20  # bytes of regions that one copy of a block parses, about
_PLACE = np.random.default_rng(13).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LAST = (1 << 63) - 1


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, also across rows."""
    n = max(0, len(h) - k + 1)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += h[j:j + n] * _PLACE[j]
    return mix(total)


def starts_in_rows(woff: np.ndarray, words: int, k: int) -> np.ndarray:
    """Whether a run of ``k`` words that starts at each word ends in its row."""
    left = np.repeat(woff[1:], np.diff(woff)) - np.arange(words)
    return (left >= k)[:max(0, words - k + 1)]


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = op(x[:len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return op(x[:len(x) - rest], x[rest:]) if rest else x


class Parsed:
    """Words and windows of rows of bytes."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, window: int):
        self.buf, self.window = buf, window
        self.starts, self.ends, self.woff = word_spans(buf, off)
        self.words = word_hashes(buf, self.starts, self.ends, lower=False)
        self.ok = starts_in_rows(self.woff, len(self.words), window)

    def hashes(self) -> np.ndarray:
        return run_hashes(self.words, self.window)

    def anchors(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The anchor's hash of every window, and the hashes at the places
        that are an anchor."""
        top = np.uint64(2**64 - 1)
        q = np.minimum(run_hashes(self.words, size), top - np.uint64(1))
        q[~starts_in_rows(self.woff, len(self.words), size)] = top
        width = self.window - size + 1
        if len(self.ok) == 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        least = sliding(q, width, np.minimum)
        pad = np.zeros(width - 1, np.uint64)
        cover = sliding(np.concatenate([pad, np.where(self.ok, least, np.uint64(0)), pad]), width, np.maximum)
        return least, q[(cover == q) & (q < top)]

    def text(self, a: int, b: int) -> bytes:
        """The bytes from word ``a`` to word ``b`` (not included)."""
        return self.buf[self.starts[a]:self.ends[b - 1]].tobytes()

    def joined(self, a: int, b: int) -> bytes:
        """Words from ``a`` to ``b`` (not included) joined by one space."""
        return b" ".join(self.text(a, b).split())


def _sliced(batches):
    for batch in batches:
        buf, off = text_buffer(batch.column(batch.num_columns - 1))
        for a, b in slices(off, SLICE):
            yield buf[off[a]:off[b]], off[a:b + 1] - off[a], batch.slice(a, b - a)


def repeated_anchors(docs: DataFrame, window: int, size: int, parts: int) -> DataFrame:
    """``key`` of anchors that occur more than once (or collide)."""
    span = np.uint64(parts << 32)

    def count(batches):
        for buf, off, _ in _sliced(batches):
            keys, n = np.unique(Parsed(buf, off, window).anchors(size)[1] % span, return_counts=True)
            if len(keys):
                yield pack((keys % np.uint64(parts)).astype(np.int64),
                           {"tokens": (keys // np.uint64(parts)).astype(np.uint32),
                            "n": np.minimum(n, 2).astype(np.uint8)})

    def add(batches):
        for (part,), (tokens, n) in groups(batches, ["part"], ["tokens", "n"]):
            tokens, back = np.unique(joined(tokens, np.uint32), return_inverse=True)
            often = tokens[np.bincount(back, joined(n, np.uint8)) > 1].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(often * parts + part)], names=["key"])

    return materialize(docs.select("text").mapInArrow(count, "part int, tokens binary, n binary")
                       .repartition(parts, "part").sortWithinPartitions("part").mapInArrow(add, "key long"))


def stretches(docs: DataFrame, window: int, size: int, parts: int) -> DataFrame:
    """``nid, digest, start, text``: the longest runs of words under windows
    whose anchor may occur again; ``start`` counts words."""
    spark = docs.sparkSession
    data = spark.sparkContext.broadcast(bit_filter(repeated_anchors(docs, window, size, parts)))
    span = np.uint64(parts << 32)

    def cut(batches):
        for buf, off, rows in _sliced(batches):
            p = Parsed(buf, off, window)
            least, _ = p.anchors(size)
            at = np.flatnonzero(p.ok)
            at = at[in_filter(data.value, least[at] % span)]
            step = np.zeros(len(p.words) + 1, np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + window, -1)
            under = np.cumsum(step)[:-1] > 0
            edge = np.zeros(len(under) + 1, bool)
            edge[p.woff] = True
            first = np.flatnonzero(under & (edge[:-1] | ~np.append(False, under[:-1])))
            last = np.flatnonzero(under & (edge[1:] | ~np.append(under[1:], False))) + 1
            if len(first) == 0:
                continue
            row = np.searchsorted(p.woff, first, "right") - 1
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(index), rows.column(1).take(index),
                 pa.array((first - p.woff[row]).astype(np.int64)),
                 pa.array([p.text(a, b) for a, b in zip(first, last)], pa.binary())],
                names=["nid", "digest", "start", "text"])

    return materialize(docs.select("nid", "digest", "text")
                       .mapInArrow(cut, "nid long, digest long, start long, text binary"))


BLOCKS = "block long, nids binary, digests binary, starts binary, off binary, text binary"


def build_blocks(cut: DataFrame, count: int) -> DataFrame:
    """Stretches in document order as one row per reference block; blocks are
    numbered in that order."""
    def gather(batches):
        from pyspark import TaskContext

        part, number, held, size, before = TaskContext.get().partitionId(), 0, [], 0, None

        def made():
            nids, digests, starts, texts = zip(*held)
            off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number])]
                + [pa.array([np.array(x, np.int64).tobytes()], pa.binary()) for x in (nids, digests, starts)]
                + [pa.array([off.tobytes()], pa.binary()), pa.array([b"".join(texts)], pa.binary())],
                names=[f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:3] == before:  # a repeated row
                    continue
                before = row[:3]
                held.append(row)
                size += len(row[3])
                if size >= BLOCK:
                    yield made()
                    number, held, size = number + 1, [], 0
        if held:
            yield made()

    order = ["nid", "digest", "start"]
    return materialize(cut.repartitionByRange(count, *order).sortWithinPartitions(*order).mapInArrow(gather, BLOCKS))


class Block:
    """A reference block with its window index."""

    def __init__(self, row: dict, window: int):
        self.number = row["block"]
        self.nids, self.digests, self.starts = (np.frombuffer(row[c], np.int64) for c in ("nids", "digests", "starts"))
        off = np.frombuffer(row["off"], np.int64)
        self.p = Parsed(np.frombuffer(row["text"], np.uint8), off, window)
        self.at = np.flatnonzero(self.p.ok)
        self.hashes = self.p.hashes()[self.at]
        self.keys, first, self.back = np.unique(self.hashes, return_index=True, return_inverse=True)
        self.first = self.at[first]  # earliest place of each distinct window
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.p.woff))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Earliest place of each window, -1 if there is none."""
        if len(self.keys) == 0:
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.first[at], -1)


def agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common beginning of two arrays of one length."""
    done, step = 0, 64
    while done < len(x):
        same = x[done:done + step] == y[done:done + step]
        if not same.all():
            return done + int(np.argmin(same))
        done, step = done + step, step * 2
    return len(x)


def parse(p: Parsed, a: int, b: int, places: np.ndarray, block: Block) -> list[tuple[int, int]]:
    """Greedy factors, of a window at least, of words ``a`` to ``b`` of ``p``
    against a block; ``places[i - a]`` is where the block first has the
    window at ``i``."""
    out, i, window = [], a, p.window
    while i <= b - window:
        at = int(places[i - a])
        if at < 0:
            i += 1
            continue
        end = int(block.p.woff[block.row[at] + 1])
        size = min(b - i, end - at)
        size = agreeing(p.words[i:i + size], block.p.words[at:at + size])
        if size < window or p.joined(i, i + size) != block.p.joined(at, at + size):
            i += 1
            continue
        out.append((i, i + size))
        i += size - window + 1  # the first window that straddles the factor's end
    return out


def first_blocks(blocks: DataFrame, window: int, parts: int) -> DataFrame:
    """``block, part, sources``: for the distinct windows of a block in a part
    of the index, by hash, the first block that has them (-1: this one)."""
    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys = Block(row, window).keys
                if len(keys):
                    tokens = (keys // np.uint64(parts)).view(np.uint8).reshape(-1, 8)[:, :6]
                    yield pack((keys % np.uint64(parts)).astype(np.int64), {"tokens": tokens}, block=row["block"])

    def answer(batches):
        for (part,), (numbers, tokens) in groups(batches, ["part"], ["block", "tokens"]):
            sizes = [len(t) // 6 for t in tokens]
            wide = np.zeros((sum(sizes), 8), np.uint8)
            wide[:, :6] = joined(tokens, np.uint8).reshape(-1, 6)
            keys, owner = wide.view(np.uint64).ravel(), np.repeat(np.array(numbers, np.int64), sizes)
            order = np.lexsort((owner, keys))
            keys, owner_ = keys[order], owner[order]
            start = np.append(True, keys[1:] != keys[:-1])
            least = owner_[np.flatnonzero(start)[np.cumsum(start) - 1]]
            source = np.empty(len(order), np.int64)
            source[order] = np.where(least < owner_, least, -1)
            cuts = np.cumsum([0, *sizes])
            for number, a, b in zip(numbers, cuts[:-1], cuts[1:]):
                if (source[a:b] >= 0).any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number]), pa.array([part], pa.int32()),
                         pa.array([source[a:b].tobytes()], pa.binary())], names=["block", "part", "sources"])

    return materialize(blocks.mapInArrow(send, "part int, block long, tokens binary")
                       .repartition(parts, "part").sortWithinPartitions("part", "block")
                       .mapInArrow(answer, "block long, part int, sources binary"))


REGIONS = "target long, text binary, nids binary, digests binary, starts binary"


def regions(blocks: DataFrame, sources: DataFrame, window: int, parts: int, tasks: int) -> DataFrame:
    """What each block has to have parsed: ``target`` is the block to parse
    against, ``text`` a region, once for all its places in the home block.
    Regions of a block's own windows come back parsed: ``target`` is null,
    ``text`` holds the lengths of the spans."""
    names = [f.split()[0] for f in REGIONS.split(", ")]

    def packed(target, text, nids, digests, starts):
        return [target, text, *[np.array(x, np.int64).tobytes() for x in (nids, digests, starts)]]

    def cut(block: Block, source: np.ndarray):
        mine = source[block.back]
        mine = np.where((mine < 0) & (block.first[block.back] < block.at), block.number, mine)
        have = np.flatnonzero(mine >= 0)
        if len(have) == 0:
            return
        at, mine = block.at[have], mine[have]
        row = block.row[at]
        start = np.append(True, (at[1:] != at[:-1] + 1) | (mine[1:] != mine[:-1]) | (row[1:] != row[:-1]))
        begin = np.flatnonzero(start)
        stop = np.append(begin[1:], len(at)) - 1
        found: dict = {}
        spans: list = []
        for a, b, target in zip(at[begin], at[stop] + window, mine[begin]):
            r = block.row[a]
            key = (int(block.nids[r]), int(block.digests[r]))
            offset = int(block.starts[r]) - int(block.p.woff[r])
            if target == block.number:
                places = block.find(run_hashes(block.p.words[a:b], window))
                spans += [(*key, x + offset, y - x) for x, y in parse(block.p, a, b, places, block)]
            else:
                found.setdefault((int(target), block.p.text(a, b)), []).append((*key, a + offset))
        out = [packed(target, text, *zip(*places)) for (target, text), places in found.items()]
        if spans:
            nids, digests, starts, sizes = zip(*spans)
            out.append(packed(None, np.array(sizes, np.int64).tobytes(), nids, digests, starts))
        kinds = [pa.int64(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    def home(batches):
        block = source = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] is None:
                    if block is not None:
                        yield from cut(block, source)
                    block = Block(row, window)
                    source = np.full(len(block.keys), -1, np.int64)
                    part = (block.keys % np.uint64(parts)).astype(np.int64)
                else:
                    source[part == row["part"]] = np.frombuffer(row["sources"], np.int64)
        if block is not None:
            yield from cut(block, source)

    both = blocks.unionByName(sources, allowMissingColumns=True)
    return materialize(both.repartition(tasks, "block").sortWithinPartitions("block", F.col("part").asc_nulls_first())
                       .mapInArrow(home, REGIONS))


SPANS = "nid long, digest long, start long, size long"


def spans(blocks: DataFrame, asked: DataFrame, window: int, tasks: int) -> DataFrame:
    """Duplicate spans of all documents, in words."""
    names = [f.split()[0] for f in SPANS.split(", ")]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    def own(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(row[c], np.int64)) for c in ("nids", "digests", "starts", "text")],
                    names=names)

    def compare(batches):
        block = None
        for batch in batches:
            todo = []
            for row in batch.to_pylist():
                if row["block"] is not None:
                    if todo:
                        yield from work(block, todo)
                    block, todo = Block(row, window), []
                else:
                    todo.append(row)
            if todo:
                yield from work(block, todo)

    def work(block, todo):
        texts = [r["region"] for r in todo]
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        p = Parsed(np.frombuffer(b"".join(texts), np.uint8), off, window)
        places = block.find(p.hashes())
        rows = []
        for i, r in enumerate(todo):
            a, b = int(p.woff[i]), int(p.woff[i + 1])
            factors = parse(p, a, b, places[a:], block)
            if factors:
                for nid, digest, start in zip(*[np.frombuffer(r[f"r_{c}"], np.int64)
                                                for c in ("nids", "digests", "starts")]):
                    rows += [(nid, digest, start + x - a, y - x) for x, y in factors]
        if rows:
            yield out(rows)

    away = asked.filter("target is not null")
    copies = materialize(away.groupBy("target").agg(
        F.ceil(F.sum(F.octet_length("text") + F.octet_length("starts") * 16 + 200) / F.lit(LOAD)).cast("int")
        .alias("copies")))
    sent = (away.join(copies, "target")
            .select("target", F.pmod(F.xxhash64("text"), "copies").cast("int").alias("copy"),
                    F.col("text").alias("region"), *[F.col(c).alias(f"r_{c}") for c in ("nids", "digests", "starts")]))
    held = (blocks.join(copies, F.col("block") == F.col("target"))
            .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies"))
    met = (held.unionByName(sent, allowMissingColumns=True).repartition(tasks, "target", "copy")
           .sortWithinPartitions("target", "copy", F.col("block").asc_nulls_last()))
    return materialize(asked.filter("target is null").mapInArrow(own, SPANS).unionByName(met.mapInArrow(compare, SPANS)))


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _result(ids, words, removed, digests):
    return pa.RecordBatch.from_arrays([ids if isinstance(ids, pa.Array) else pa.array(ids, pa.int64()),
                                       pa.array(words, pa.int64()), pa.array(removed, pa.int64()),
                                       pa.array(digests, pa.string())], names=[f.split()[0] for f in RESULT.split(", ")])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                   anchor: int = 8) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    ids = F.col(f"`{id_col}`").cast("long")
    docs = docs.select(ids.alias("doc_id"), F.coalesce(ids, F.lit(_LAST)).alias("nid"),
                       F.xxhash64(text).alias("digest"), text.alias("text"))
    spark = docs.sparkSession
    sums = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, math.ceil((sums[0] or 0) / 6 / PART))
    cut = stretches(docs, window, anchor, parts)
    size = cut.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(least, math.ceil(size / BLOCK))
    blocks = build_blocks(cut, tasks)
    asked = regions(blocks, first_blocks(blocks, window, parts), window, parts, tasks)
    found = spans(blocks, asked, window, tasks)

    again = materialize(docs.groupBy("nid", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    key = F.xxhash64("nid", "digest").alias("key")
    data = spark.sparkContext.broadcast(bit_filter(
        found.select(key).distinct().unionByName(again.select(key))))

    def whole(batches):
        for batch in batches:
            batch = batch.filter(pa.array(~in_filter(data.value, batch.column(1).to_numpy())))
            texts = [t.encode().split() for t in batch.column(2).to_pylist()]  # the same six bytes part words
            yield _result(batch.column(0), [len(t) for t in texts], np.zeros(len(texts), np.int64),
                          [hashlib.sha256(b" ".join(t)).hexdigest() for t in texts])

    def some(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_filter(data.value, batch.column("key").to_numpy())))

    def without(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                words = r["text"].encode().split()
                keep = np.ones(len(words), bool)
                for start, n in zip(r["starts"] or [], r["sizes"] or []):
                    keep[start:start + n] = False
                kept = [w for w, k in zip(words, keep.tolist()) if k]
                rows.append((r["doc_id"], len(words), len(words) - len(kept),
                             hashlib.sha256(b" ".join(kept)).hexdigest()))
                if r["n"] > 1:
                    kept = words if len(words) < window else []
                    rows += [(r["doc_id"], len(words), len(words) - len(kept),
                              hashlib.sha256(b" ".join(kept)).hexdigest())] * (r["n"] - 1)
            if rows:
                yield _result(*zip(*rows))

    here = docs.select("doc_id", key, "text").mapInArrow(whole, RESULT)
    moved = (docs.select("doc_id", "nid", "digest", key, "text")
             .mapInArrow(some, "doc_id long, nid long, digest long, key long, text string")
             .groupBy("nid", "digest").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"),
                                           F.count(F.lit(1)).alias("n")))
    lists = found.groupBy("nid", "digest").agg(F.collect_list("start").alias("starts"),
                                               F.collect_list("size").alias("sizes"))
    return here.unionByName(moved.join(lists, ["nid", "digest"], "left")
                            .select("doc_id", "text", "n", "starts", "sizes").mapInArrow(without, RESULT))
