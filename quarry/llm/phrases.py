"""Phrases of words that belong together, mined by shards (SON partitioning).

Documents are dealt to shards by a hash of their text.  A shard's local
support is the global one lowered to the shard's share of all bytes, rounded
up; a phrase that is frequent in the whole is so in at least one shard, as the
local supports would else not add up.  Every shard is mined completely (all
runs of up to ``longest`` words, counted under 32-bit remainders of their
hashes next to a part number, which only adds candidates), the locally
frequent ones are united, and a second scan counts all candidates globally by
their words.  The candidates reach that scan as a bit filter of bounded size;
what else it lets pass is counted exactly, too, and then is too rare.

Both counts are added up inside a task before they are shuffled, so a word or
phrase that fills a third of the corpus is one value a slice.  Ranks come from
a range partitioning by (language, score), in which no language is one group.

Texts are cut at ``.,;:!?`` and line ends into pieces, words inside a piece
are parted by spaces and tabs, and only A-Z are lower-cased.  Null texts are
empty; a null language is ``und``; repeated rows count each time; texts
without words, and an empty table, give no rows.  Texts are read whole.  Other
columns are not looked at.  Equal scores are ordered by frequency, then by the
phrase's bytes.  Inside one slice of texts words are told apart by 64-bit
hashes (a collision has a probability under 1e-8 per slice).
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import slices, text_buffer
from quarry.llm.packed import bit_filter, groups, in_filter, joined, pack
from quarry.llm.words import LOWER, mix, word_hashes, word_spans
from quarry.session import materialize

SLICE = 4 << 20  # bytes of text counted at once
PART_WORDS = 1_500_000  # words whose runs share a part of the mining table
# Bytes that end a piece, and bytes that part words as well.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
APART = ENDS.copy()
APART[[0x20, 0x09]] = True
_PLACE = np.random.default_rng(12).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


class Runs:
    """Words of a slice of texts and their contiguous runs inside pieces."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, langs: pa.Array):
        self.buf = LOWER[buf]
        self.starts, self.ends, woff = word_spans(buf, off, APART)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(woff))
        self.hashes = word_hashes(buf, self.starts, self.ends)
        piece = np.cumsum(ENDS[buf])[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        self.near = (self.row[1:] == self.row[:-1]) & (piece[1:] == piece[:-1])
        names = langs.dictionary_encode()
        self.langs, self.lang = names.dictionary, names.indices.to_numpy(zero_copy_only=False)[self.row]
        lbuf, loff = text_buffer(self.langs)
        edge = np.arange(len(loff) - 1)
        self.lang_hash = mix(np.array([_bytes_hash(lbuf[loff[i]:loff[i + 1]]) for i in edge], np.uint64))

    def begin(self, k: int) -> np.ndarray:
        """First words of all runs of ``k`` words."""
        ok = np.ones(max(0, len(self.starts) - k + 1), bool)
        for j in range(k - 1):
            ok &= self.near[j:j + len(ok)]
        return np.flatnonzero(ok)

    def key(self, first: np.ndarray, k: int) -> np.ndarray:
        """A hash of each run and its language."""
        total = self.lang_hash[self.lang[first]] + _PLACE[63 - k]
        for j in range(k):
            total = total + self.hashes[first + j] * _PLACE[j]
        return mix(total)

    def counted(self, keep, longest: int):
        """Language, length, text and number of each distinct run that ``keep``
        lets pass (a test of keys), and of all words as length 0."""
        words, one, back = np.unique(self.hashes, return_index=True, return_inverse=True)
        texts = _texts(self.buf, self.starts[one], self.ends[one])
        out = [(self.langs, np.zeros(len(self.langs), np.int32), pa.array([""] * len(self.langs)),
                np.bincount(self.lang, minlength=len(self.langs)))]
        for k in range(1, longest + 1):
            first = self.begin(k)
            first = first[keep(self.key(first, k))]
            code = self.lang[first].astype(np.int64)
            for j in range(k):
                code = np.unique(code * len(words) + back[first + j], return_inverse=True)[1]
            _, at, n = np.unique(code, return_index=True, return_counts=True)
            first = first[at]
            parts = [texts.take(pa.array(back[first + j])) for j in range(k)]
            text = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", parts[0].type))
            out.append((self.langs.take(pa.array(self.lang[first])), np.full(len(n), k, np.int32), text, n))
        return out


def _bytes_hash(raw: np.ndarray) -> int:
    at = np.arange(len(raw), dtype=np.uint64)
    return int((mix(raw.astype(np.uint64) + np.uint64(1) + (at << np.uint64(9)))).sum(dtype=np.uint64))


def _texts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    place = np.arange(off[-1]) + np.repeat(starts - off[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(size),
                                 [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(buf[place]))])


def _sliced(batches):
    """Runs and rows of each slice of batches (text, language, ...)."""
    for batch in batches:
        buf, off = text_buffer(batch.column(0))
        for a, b in slices(off, SLICE):
            yield Runs(buf[off[a]:off[b]], off[a:b + 1] - off[a], batch.column(1).slice(a, b - a)), batch.slice(a, b - a)


def supports(docs: DataFrame, shards: int, support: int) -> tuple[list[int], int]:
    """The local support of each shard, and the bytes of all texts."""
    size = {r["shard"]: r["size"] for r in docs.groupBy("shard").agg(
        F.sum(F.octet_length("text")).alias("size")).collect()}
    whole = max(1, sum(size.values()))
    return [max(1, -(-support * size.get(s, 0) // whole)) for s in range(shards)], whole


def mine(docs: DataFrame, local: list[int], parts: int, longest: int) -> DataFrame:
    """``key`` of every run that reaches its shard's local support in a shard
    (and of few others whose keys collide with such)."""
    span = np.uint64(parts << 32)

    def count(batches):
        for runs, rows in _sliced(batches):
            shard = rows.column(2).to_numpy()[runs.row]
            for s in range(len(local)):
                keys = []
                for k in range(1, longest + 1):
                    first = runs.begin(k)
                    keys.append(runs.key(first[shard[first] == s], k) % span)
                keys, n = np.unique(np.concatenate(keys), return_counts=True)
                if len(keys):
                    yield pack((keys % np.uint64(parts)).astype(np.int64),
                               {"tokens": (keys // np.uint64(parts)).astype(np.uint32),
                                "n": np.minimum(n, 255).astype(np.uint8)}, shard=np.int32(s))

    def add(batches):
        for (part, shard), (tokens, n) in groups(batches, ["part", "shard"], ["tokens", "n"]):
            tokens, back = np.unique(joined(tokens, np.uint32), return_inverse=True)
            total = np.bincount(back, joined(n, np.uint8))
            often = tokens[total >= min(local[shard], 255)].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(often * parts + part)], names=["key"])

    mined = (docs.select("text", "lang", "shard")
             .mapInArrow(count, "part int, shard int, tokens binary, n binary")
             .repartition(parts, "part").sortWithinPartitions("part", "shard").mapInArrow(add, "key long"))
    return materialize(mined)


def count_all(docs: DataFrame, keys: DataFrame, parts: int, longest: int, support: int) -> DataFrame:
    """``lang, k, phrase, n``: exact counts of all candidates that reach
    ``support``; with ``k`` 0 all words of a language."""
    data = docs.sparkSession.sparkContext.broadcast(bit_filter(keys))
    span = np.uint64(parts << 32)

    def count(batches):
        table = data.value
        for runs, _ in _sliced(batches):
            for lang, k, phrase, n in runs.counted(lambda key: in_filter(table, key % span), longest):
                yield pa.RecordBatch.from_arrays(
                    [lang.cast(pa.string()), pa.array(k), phrase.cast(pa.string()), pa.array(n.astype(np.int64))],
                    names=["lang", "k", "phrase", "n"])

    counted = (docs.select("text", "lang").mapInArrow(count, "lang string, k int, phrase string, n long")
               .groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")))
    return materialize(counted.filter((F.col("n") >= support) | (F.col("k") == 0)))


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, k, a, l, r, score`` of every candidate: the cut that
    scores lowest, in whole numbers throughout (decimals of 38 digits)."""
    cuts = (counts.filter("k > 1").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
            .withColumn("w", F.split("phrase", " "))
            .select("lang", "phrase", "k", F.col("n").alias("a"), "cut",
                    _part(F.col("w"), F.lit(1), F.col("cut")).alias("first"),
                    _part(F.col("w"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest")))
    known = counts.filter("k > 0")
    for side, n in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("n").alias(n)), ["lang", side])
    whole = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}
    square = (whole["a"] * whole["a"]).cast("decimal(31,0)")
    cuts = cuts.withColumn("top", square * F.lit(1_000_000).cast("decimal(7,0)"))
    cuts = cuts.withColumn("under", (whole["l"] * whole["r"]).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("top div under"))
    best = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "k", "a", "best.l", "best.r", "best.score")


def inside_longer(candidates: DataFrame, share: int) -> DataFrame:
    """``lang, phrase`` of candidates inside a longer one that holds at least
    ``share`` percent of their occurrences."""
    inner = (candidates.filter("k > 2").withColumn("w", F.split("phrase", " "))
             .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
             .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
             .groupBy("lang", _part(F.col("w"), F.col("at"), F.col("size")).alias("phrase"))
             .agg(F.max("n").alias("longer")))
    return (candidates.join(inner, ["lang", "phrase"])
            .filter(F.col("longer") * 100 >= F.col("n") * share).select("lang", "phrase"))


def ranked(rows: DataFrame, order: list, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their ``rank``.  Rows are
    range partitioned by language and order, every partition keeps its first
    ``top`` rows of a language, and ranks go on where the partitions before
    ended."""
    schema = rows.schema

    def number(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            langs = batch.column(schema.names.index("lang")).to_pylist()
            place = []
            for lang in langs:
                seen[lang] = seen.get(lang, 0) + 1
                place.append(seen[lang])
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(langs), pa.int32()),
                                              pa.array(place, pa.int64())], names=[*schema.names, "part", "place"])
            yield out.filter(pc.less_equal(out.column("place"), top))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(rows.repartitionByRange(n, "lang", *order).sortWithinPartitions("lang", *order)
                         .mapInArrow(number, f"{fields}, part int, place long"))
    ends = placed.groupBy("lang", "part").agg(F.max("place").alias("rows"))
    before = (ends.alias("x").join(ends.alias("y"), (F.col("x.lang") == F.col("y.lang"))
                                   & (F.col("y.part") < F.col("x.part")), "left")
              .groupBy(F.col("x.lang").alias("lang"), F.col("x.part").alias("part"))
              .agg(F.coalesce(F.sum("y.rows"), F.lit(0)).alias("before")))
    return (placed.join(before, ["lang", "part"]).withColumn("rank", F.col("place") + F.col("before"))
            .filter(F.col("rank") <= top).drop("part", "place", "before"))


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = 10, longest: int = 3,
            share: int = 50, top: int = 2000, shards: int = 4) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first
    ``top`` phrases of 2 to ``longest`` words that occur at least ``support``
    times, less those that a longer candidate holds in ``share`` percent."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    docs = docs.select(text.alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                       F.pmod(F.xxhash64(text), F.lit(shards)).cast("int").alias("shard"))
    local, size = supports(docs, shards, support)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / 6 / PART_WORDS))
    counts = count_all(docs, mine(docs, local, parts, longest), parts, longest, support)
    good = scored(counts).join(inside_longer(counts.filter("k > 1"), share), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = ranked(good.select("lang", "phrase", "a", "l", "r", "score"), order, top)
    words = counts.filter("k = 0").select("lang", "n")
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
