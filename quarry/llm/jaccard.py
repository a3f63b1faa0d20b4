"""Exact Jaccard join of texts on word shingles: a size-aware heavy-light join.

Texts with equal shingle sets are one class, known by a 64-bit hash of the set
and its size.  Two sets link when their overlap reaches
``ceil(num * (|x| + |y|) / (num + den))``.

* Light sets, up to a size boundary, enumerate the subsets of the overlap
  sizes they need; sets that share such a subset link with the smallest of
  them, so a subset shared by many gives a star, already verified.
* Heavy sets (and light ones that can link with heavy ones) put a prefix of
  their shingles into inverted lists.  The prefix order is the same for all:
  shingles by hash, and the most frequent ones, a bounded table of counts over
  all documents, last.  Any order finds all links; this one keeps passages
  shared by many texts out of the prefixes.  Prefixes are a little longer than
  one common shingle asks for, so that linked sets meet in ``TOGETHER`` lists
  (or their whole overlap): sets that meet in fewer by chance are no candidates.
* The boundary is the largest size whose enumeration costs less than scanning
  its lists, both estimated from the counts.

Lists are met in rounds.  First only neighbours by size are candidates, which
is linear in a list; then, while it pays, members outside a list's largest
component meet the members of it that are in most lists; each round is
verified exactly and followed by connected components.  Last, a list gives all
pairs whose ends are still in different components, less those verified.  Then
every two sets that meet often enough are connected or verified, so no link is
lost for the components, and a large group of copies never becomes all its
pairs.

Every set has a sketch, the parities of its shingles by bit, of the first
power of two bits that is at least its size and ``SKETCH``; a longer sketch
folds to a shorter one.  Where two sketches differ the sets differ, so ``(|x| +
|y| - differing bits) / 2`` bounds the overlap from above: pairs that it rules
out are not verified.  A sketch of a fixed size says nothing of sets much
larger than it, and then all that meet by a shared passage would be sent to be
compared.  In the last round sketches folded to ``SKETCH`` bits rule out pairs
in the task that met them, and a crowd of near copies that do not link leaves
its task as few pairs.

Verification sends each set to the smaller end of its pairs; an end that many
sets are sent to is copied for every ``GUESTS`` of them.  A bounded Bloom
filter of the ids in question spares the scan the sets that nobody asked for;
the join behind it is exact.

Null texts and texts without words have an empty set and link with nothing;
texts of fewer words than a shingle have their word sequence as one shingle.
Equal texts, repeated rows and rows that share an id, whatever their texts
(one node), end in one component.
Null ids are left out of components and get a null one.  Very long texts are
shingled whole.  An empty table gives an empty table.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField

from quarry.llm.batches import per_text, slices, text_buffer
from quarry.llm.components import components
from quarry.llm.ids import id_filter, passes, spot
from quarry.llm.words import Lookup, mix, text_shingles
from quarry.session import materialize, scratch_tables

FREQUENT = 1 << 17  # most frequent shingles that go last in every prefix
FREQUENT_FROM = 8  # texts that must share a shingle for that
LIGHT_LIMIT = 16  # sizes that are ever enumerated
GROUP_POSTINGS = 500_000  # postings that a group of lists should have
TOKEN_BYTES = 5  # bytes of a shingle's hash kept for verification
TOGETHER = 5  # lists that linked sets share at least
SKETCH = 512  # bits of the smallest sketch of a set
GUESTS = 128  # sets that are compared with one copy of a set, about
HUBS = 3  # members of a list's largest component that the others meet first
_SALT = np.uint64(0xD6E8FEB86659FD93)


class Threshold:
    """``similarity >= num / den`` as sizes and overlaps."""

    def __init__(self, num: int = 3, den: int = 4):
        self.num, self.den = num, den

    def overlap(self, x, y):
        return -(-(self.num * (x + y)) // (self.num + self.den))

    def prefix(self, n):
        """Shingles of a set of ``n`` that go into lists: two linked sets have
        ``together`` of them in common."""
        return np.minimum(n, n + (-self.num * n) // self.den + TOGETHER)

    def together(self, x, y):
        return np.minimum(TOGETHER, self.overlap(x, y))

    def close(self, small, large):
        return self.den * small >= self.num * large

    def needed(self, n: int) -> list[int]:
        """Overlap sizes that a set of ``n`` may need, largest partner first."""
        low, high = -(-self.num * n // self.den), n * self.den // self.num
        return sorted({int(self.overlap(n, t)) for t in range(low, high + 1)}
                      & set(range(1, n + 1)), reverse=True)

    def subsets(self, n: int) -> int:
        return sum(math.comb(n, c) for c in self.needed(n))


def row_sets(buf: np.ndarray, off: np.ndarray, words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each row, ascending."""
    hashes, so = text_shingles(buf, off, words)
    return [np.unique(hashes[a:b]) for a, b in zip(so[:-1], so[1:])]


def set_key(tokens: np.ndarray) -> np.int64:
    return mix(tokens ^ _SALT).sum(dtype=np.uint64).astype(np.int64)


def sketch_bits(n: int) -> int:
    return max(SKETCH, 1 << max(0, n - 1).bit_length())


def sketch(tokens: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """The parity of the number of shingles at each of ``bits`` bits."""
    odd = np.bincount((tokens >> np.uint64(7)) % np.uint64(bits), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(wide: Column, size: Column) -> Column:
    """A sketch as one of ``size`` longs, or as it is if it is no longer."""
    words = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(
        F.sequence(F.lit(0), (F.size(wide) / size).cast("int") - 1), F.lit(0).cast("long"),
        lambda total, j: total.bitwiseXOR(F.get(wide, i + j * size))))
    return F.when(F.size(wide) <= size, wide).otherwise(words)


def differing(x: Column, y: Column) -> Column:
    """Bits in which two sketches differ, the longer one folded."""
    return F.aggregate(F.zip_with(folded(x, F.size(y)), folded(y, F.size(x)),
                                  lambda a, b: F.bit_count(a.bitwiseXOR(b))),
                       F.lit(0), lambda total, n: total + n)


def may_link(limit: Threshold, nx, ny, differing):
    """Whether sketches that differ in so many bits allow the overlap."""
    return nx + ny - differing >= 2 * limit.overlap(nx, ny)


def describe(docs: DataFrame, words: int, limit: Threshold, id_col: str, text_col: str) -> DataFrame:
    """``id, n, key, sketch, head``: size, key and sketch of each row's set and
    the upper half of the hashes in its hash-order prefix."""
    def make(buf, off):
        sets = row_sets(buf, off, words)
        heads = [(t[:limit.prefix(len(t))] >> np.uint64(32)).astype(np.uint32).tobytes() if len(t) else b""
                 for t in sets]
        sketched = [sketch(t, sketch_bits(len(t))) for t in sets]
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in sketched])]).astype(np.int32)
        sketches = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(sketched)))
        return [np.array([len(t) for t in sets], np.int32),
                np.array([set_key(t) for t in sets], np.int64), sketches, pa.array(heads, pa.binary())]

    fields = [StructField("n", IntegerType()), StructField("key", LongType()),
              StructField("sketch", ArrayType(LongType())), StructField("head", BinaryType())]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return per_text(rows, "text", ["id"], fields, make)


def _blobs(group: np.ndarray, columns: list[np.ndarray], names: list[str]):
    """Arrow rows, one per group number, each column's values as bytes."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
    ends = np.append(cuts[1:], len(group))
    arrays = [pa.array(group[cuts].astype(np.int32))]
    for column in columns:
        column = column[order]
        arrays.append(pa.array([column[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["part"] + names)


def _parts(batches, names: list[str], types: list):
    """Per part number (rows sorted by it): its columns, joined up."""
    held: list[list[bytes]] = [[] for _ in names]
    part = None

    def whole():
        return [np.frombuffer(b"".join(h), t) for h, t in zip(held, types)]

    for batch in batches:
        columns = [batch.column(c) for c in names]
        for i, p in enumerate(batch.column("part").to_pylist()):
            if p != part:
                if part is not None:
                    yield part, whole()
                part, held = p, [[] for _ in names]
            for h, c in zip(held, columns):
                h.append(c[i].as_py())
    if part is not None:
        yield part, whole()


def frequent(rows: DataFrame, parts: int) -> tuple[np.ndarray, float]:
    """The most frequent prefix hashes, rarest first, and the mean length of
    the list that a posting lies in, over all of them."""
    def split(batches):
        for batch in batches:
            tokens = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32)
            tokens, n = np.unique(tokens, return_counts=True)
            yield _blobs((tokens.astype(np.int64) * 40503 >> 8) % parts, [tokens, n.astype(np.uint32)],
                         ["tokens", "n"])

    def add(batches):
        for _, (tokens, n) in _parts(batches, ["tokens", "n"], [np.uint32, np.uint32]):
            tokens, back = np.unique(tokens, return_inverse=True)
            n = np.bincount(back, n).astype(np.int64)
            often = n > FREQUENT_FROM
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[often].astype(np.int64)), pa.array(n[often]),
                 pa.array(np.full(often.sum(), 0.0)), pa.array(np.full(often.sum(), 0.0))],
                names=["token", "n", "square", "total"])
            rest = n[~often].astype(float)
            yield pa.RecordBatch.from_arrays(
                [pa.array([None], pa.int64()), pa.array([0]), pa.array([float((rest**2).sum())]),
                 pa.array([float(rest.sum())])], names=["token", "n", "square", "total"])

    counts = materialize(
        rows.select("head").mapInArrow(split, "part int, tokens binary, n binary")
        .repartition(parts, "part").sortWithinPartitions("part")
        .mapInArrow(add, "token long, n long, square double, total double"))
    top = (counts.filter("token is not null").select("token", "n").orderBy(F.desc("n"), "token")
           .limit(FREQUENT).toArrow())
    sums = counts.agg(F.sum("square"), F.sum("total")).first()
    return top.column(0).to_numpy()[::-1].astype(np.uint64), (sums[0] or 0.0) / max(1.0, sums[1] or 0.0)


def boundary(limit: Threshold, list_length: float) -> int:
    """The largest set size whose subsets are fewer than the list entries and
    verification steps that scanning its prefix would cost."""
    best = 0
    for n in range(1, LIGHT_LIMIT + 1):
        if limit.subsets(n) <= limit.prefix(n) * max(1.0, list_length) * n:
            best = n
    return best


def _subset_postings(tokens: np.ndarray, limit: Threshold):
    """Hash and size of every subset that the set enumerates."""
    from itertools import combinations

    hashed = mix(tokens + _SALT)
    found, sizes = [], []
    for c in limit.needed(len(tokens)):
        picks = np.array(list(combinations(range(len(tokens)), c)))
        found.append(mix(hashed[picks].sum(axis=1, dtype=np.uint64) + np.uint64(c)))
        sizes.append(np.full(len(picks), c))
    return np.concatenate(found), np.concatenate(sizes)


def postings(docs: DataFrame, words: int, limit: Threshold, light: int, often: np.ndarray, parts: int,
             text_col: str) -> DataFrame:
    """Packed postings by list group: hash, set key, set size, and 0, or less
    than 0 for a subset's size."""
    data = docs.sparkSession.sparkContext.broadcast(often)
    names = ["tokens", "keys", "sizes", "places"]

    def make(batches):
        last = Lookup(data.value)
        for batch in batches:
            buf, off = text_buffer(batch.column(0))
            columns: list[list[np.ndarray]] = [[] for _ in names]
            seen: set[int] = set()
            for a, b in slices(off):
                sets = row_sets(buf[off[a]:off[b]], off[a:b + 1] - off[a], words)
                sizes = np.array([len(t) for t in sets])
                every = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
                rank = last.find(every >> np.uint64(32))
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                for i, t in enumerate(sets):
                    n = len(t)
                    if n == 0:
                        continue
                    key = set_key(t)
                    if (int(key), n) in seen:  # a copy in the same batch
                        continue
                    seen.add((int(key), n))
                    out, place = [], []
                    if n <= light:
                        h, c = _subset_postings(t, limit)
                        out.append(h)
                        place.append(-c)
                    if n > light or limit.close(n, light + 1):
                        r = rank[cuts[i]:cuts[i + 1]]
                        order = np.argsort(r, kind="stable") if (r >= 0).any() else slice(None)
                        head = t[order][:limit.prefix(n)]
                        out.append(head)
                        place.append(np.zeros(len(head), np.int32))
                    out_, place_ = np.concatenate(out), np.concatenate(place)
                    columns[0].append(out_)
                    columns[1].append(np.full(len(out_), key))
                    columns[2].append(np.full(len(out_), n, np.int32))
                    columns[3].append(place_.astype(np.int32))
            if columns[0]:
                arrays = [np.concatenate(c) for c in columns]
                group = (arrays[0] % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((arrays[3], arrays[1], group))
                yield _blobs(group[order], [x[order] for x in arrays], names)

    return (docs.select(F.col(f"`{text_col}`").alias("text"))
            .mapInArrow(make, "part int, " + ", ".join(f"{c} binary" for c in names))
            .repartition(parts, "part").sortWithinPartitions("part"))


def lists(packed: DataFrame, limit: Threshold, light: int) -> DataFrame:
    """Distinct lists, ``mark, keys, sizes, times`` with members by size and
    the number of shingles that have the same members; with ``mark`` null the
    links that subsets prove (first member with each other)."""
    def scan(batches):
        types = [np.uint64, np.int64, np.int32, np.int32]
        for _, (tokens, keys, sizes, places) in _parts(batches, ["tokens", "keys", "sizes", "places"], types):
            order = np.lexsort((keys, sizes, places < 0, tokens))
            tokens, keys, sizes, places = (x[order] for x in (tokens, keys, sizes, places))
            subset = places < 0
            new = np.ones(len(tokens), bool)
            new[1:] = ((tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1]) | (sizes[1:] != sizes[:-1])
                       | (subset[1:] != subset[:-1]))
            tokens, keys, sizes, places, subset = (x[new] for x in (tokens, keys, sizes, places, subset))
            if len(tokens) == 0:
                continue
            start = np.ones(len(tokens), bool)
            start[1:] = (tokens[1:] != tokens[:-1]) | (subset[1:] != subset[:-1])
            cuts = np.flatnonzero(start)
            ends = np.append(cuts[1:], len(tokens))
            out: dict = {}
            for a, b in zip(cuts[ends - cuts > 1], ends[ends - cuts > 1]):
                k, s = keys[a:b], sizes[a:b]
                if subset[a]:
                    ok = limit.overlap(s[0], s) <= -places[a]
                    if ok[1:].any():
                        ok[0] = True
                        out[("s", k[ok].tobytes())] = [None, k[ok], s[ok], 1]
                    continue
                if s[-1] <= light:
                    continue
                near = limit.close(s[:-1], s[1:])  # a link's ends are close to all sizes between
                keep = np.append(near, False) | np.append(False, near)
                k, s = k[keep], s[keep]
                if len(k) > 1:
                    mark = int(mix(k.astype(np.uint64)).sum(dtype=np.uint64).astype(np.int64))
                    out.setdefault(("l", mark), [mark, k, s, 0])[3] += 1
            if out:
                rows = list(out.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                     pa.array([r[2] for r in rows], pa.list_(pa.int32())),
                     pa.array([r[3] for r in rows], pa.int64())], names=["mark", "keys", "sizes", "times"])

    return materialize(packed.mapInArrow(scan, "mark long, keys array<long>, sizes array<int>, times long"))


PAIR = "x long, nx int, y long, ny int, times long"


def _pair_batch(x, nx, y, ny, times):
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(nx, pa.int32()), pa.array(y, pa.int64()),
                                       pa.array(ny, pa.int32()), pa.array(times, pa.int64())],
                                      names=["x", "nx", "y", "ny", "times"])


def often_enough(pairs: DataFrame, limit: Threshold) -> DataFrame:
    """Pairs that meet as often as a link needs to."""
    need = F.least(F.lit(TOGETHER), F.ceil((F.col("nx") + F.col("ny")) * F.lit(limit.num)
                                           / F.lit(limit.num + limit.den)))
    return (pairs.groupBy("x", "nx", "y", "ny").agg(F.sum("times").alias("times"))
            .filter(F.col("times") >= need).drop("times"))


def neighbours(table: DataFrame, limit: Threshold) -> DataFrame:
    """Pairs of list members next to each other in size."""
    def pairs(batches):
        for batch in batches:
            keys, sizes = batch.column("keys"), batch.column("sizes")
            k, s = keys.flatten().to_numpy(), sizes.flatten().to_numpy()
            row = np.repeat(np.arange(len(keys)), np.diff(keys.offsets.to_numpy()))
            times = batch.column("times").to_numpy()[row]
            ok = (row[1:] == row[:-1]) & limit.close(s[:-1], s[1:])
            yield _pair_batch(k[:-1][ok], s[:-1][ok], k[1:][ok], s[1:][ok], times[1:][ok])

    return table.mapInArrow(pairs, PAIR)


def mixed_lists(table: DataFrame, groups: DataFrame, more: list[str] = []) -> DataFrame:
    """Lists of more than two members in several components: ``members``
    (``key, n, degree, component``; the degree is how many shingles the set
    has in such lists; and the columns ``more`` of ``groups``) and ``times``."""
    single = table.select("mark", "times", F.explode(F.arrays_zip("keys", "sizes")).alias("m"))
    single = single.select("mark", "times", F.col("m.keys").alias("key"), F.col("m.sizes").alias("n"))
    degree = materialize(single.groupBy("key", "n").agg(F.sum("times").alias("degree"))
                         .join(groups.select("key", "n", "component", *more), ["key", "n"]))
    return (single.join(degree, ["key", "n"]).groupBy("mark")
            .agg(F.collect_list(F.struct("key", "n", "degree", "component", *more)).alias("members"),
                 F.first("times").alias("times"), F.min("component").alias("low"),
                 F.max("component").alias("high"))
            .filter("low != high").select("members", "times"))


def _members(batch):
    for members, times in zip(batch.column("members"), batch.column("times").to_pylist()):
        flat = members.values
        k, s, d, g = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        order = np.lexsort((k, s))
        z = flat.field(4).flatten().to_numpy().reshape(len(k), -1)[order] if flat.type.num_fields > 4 else None
        yield k[order], s[order], d[order], g[order], times, z


def to_hubs(mixed: DataFrame, limit: Threshold, light: int, turn: int) -> DataFrame:
    """Members outside a list's largest component with its members of the
    highest degree (the next ones every ``turn``) and with their own
    neighbour in size."""
    def pairs(batches):
        for batch in batches:
            for k, s, d, g, times, _ in _members(batch):
                parts, back, n = np.unique(g, return_inverse=True, return_counts=True)
                large = np.flatnonzero(back == np.argmax(n))
                stray = np.flatnonzero(back != np.argmax(n))
                hubs = large[np.lexsort((k[large], -d[large]))][turn * HUBS:(turn + 1) * HUBS]
                a, b = np.repeat(stray, len(hubs)), np.tile(hubs, len(stray))
                apart = g[stray[1:]] != g[stray[:-1]]
                a, b = np.append(a, stray[:-1][apart]), np.append(b, stray[1:][apart])
                a, b = np.minimum(a, b), np.maximum(a, b)
                ok = limit.close(s[a], s[b]) & (s[b] > light)
                a, b = a[ok], b[ok]
                yield _pair_batch(k[a], s[a], k[b], s[b], np.full(len(a), times))

    return mixed.mapInArrow(pairs, PAIR).drop("times").distinct()


def _summed(rows: list) -> list:
    """Pair columns with equal pairs added up."""
    x, nx, y, ny, times = (np.concatenate(c) for c in zip(*rows))
    order = np.lexsort((y, x))
    x, nx, y, ny, times = (c[order] for c in (x, nx, y, ny, times))
    start = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (nx[1:] != nx[:-1])
                                     | (ny[1:] != ny[:-1])))
    return [(x[start], nx[start], y[start], ny[start], np.add.reduceat(times, start))]


def across(mixed: DataFrame, limit: Threshold, light: int, hold: int = 1_000_000) -> DataFrame:
    """All pairs of list members in different components that their sketches
    allow to link, equal pairs added up inside a task, which holds about
    ``hold`` of them at a time."""
    def pairs(batches):
        rows: list = []
        held = 0
        for batch in batches:
            for k, s, _, g, times, z in _members(batch):
                for i in range(len(k) - 1):
                    stop = int(np.searchsorted(s, s[i] * limit.den // limit.num, "right"))
                    j = np.arange(i + 1, stop)
                    j = j[(g[j] != g[i]) & (s[j] > light)]
                    if len(j):
                        apart = np.bitwise_count((z[j] ^ z[i]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                        j = j[may_link(limit, int(s[i]), s[j].astype(np.int64), apart)]
                    if len(j):
                        rows.append((np.full(len(j), k[i]), np.full(len(j), s[i]), k[j], s[j],
                                     np.full(len(j), times)))
                        held += len(j)
                if held > hold:
                    rows = _summed(rows)
                    held = len(rows[0][0])
                    if held > hold // 2:
                        yield _pair_batch(*rows[0])
                        rows, held = [], 0
        if rows:
            yield _pair_batch(*_summed(rows)[0])

    return mixed.mapInArrow(pairs, PAIR)


def verify(docs: DataFrame, pairs: DataFrame, words: int, limit: Threshold, id_col: str,
           text_col: str) -> DataFrame:
    """Of the pairs ``a, x, b, y`` (id of a text and key of its set, twice)
    the ids of those whose overlap is large enough."""
    rooms = pairs.groupBy("a", "x").agg(F.ceil(F.count(F.lit(1)) / F.lit(GUESTS)).cast("int").alias("rooms"))
    rooms = materialize(rooms)
    host = rooms.select(F.col("a").alias("id"), F.col("x").alias("key"), F.col("a").alias("meet"),
                        F.col("x").alias("meet_key"), F.explode(F.sequence(F.lit(0), F.col("rooms") - 1)).alias("room"),
                        F.lit(0).alias("guest"))
    guests = pairs.join(rooms, ["a", "x"]).select(
        F.col("b").alias("id"), F.col("y").alias("key"), F.col("a").alias("meet"), F.col("x").alias("meet_key"),
        F.pmod(F.xxhash64("b", "y"), F.col("rooms")).cast("int").alias("room"), F.lit(1).alias("guest"))
    sends = materialize(host.unionByName(guests))
    ids = sends.select("id").distinct()
    table, bits = id_filter(ids, "id")
    data = docs.sparkSession.sparkContext.broadcast(table)
    rows = (docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                        *[spot(F.col(f"`{id_col}`"), i, bits).alias(f"b{i}") for i in (0, 1)]))

    def make(batches):
        bloom = data.value
        for batch in batches:
            hit = passes(bloom, batch.column("b0").to_numpy(), batch.column("b1").to_numpy())
            batch = batch.filter(pa.array(hit))
            buf, off = text_buffer(batch.column("text"))
            for a, b in slices(off):
                sets = row_sets(buf[off[a]:off[b]], off[a:b + 1] - off[a], words)
                packed = [np.ascontiguousarray(
                    t.view(np.uint8).reshape(-1, 8)[:, 8 - TOKEN_BYTES:]).tobytes() for t in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array([set_key(t) for t in sets], pa.int64()),
                     pa.array(packed, pa.binary())], names=["id", "key", "tokens"])

    def unpack(blob: bytes) -> np.ndarray:
        raw = np.frombuffer(blob, np.uint8).reshape(-1, TOKEN_BYTES)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, 8 - TOKEN_BYTES:] = raw
        return wide.view(np.uint64).ravel()  # ascending, as the upper bytes are kept

    def compare(batches):
        meet = host = None
        for batch in batches:
            out = []
            meets = zip(*[batch.column(c).to_pylist() for c in ("meet", "meet_key", "room")])
            for i, (m, guest) in enumerate(zip(meets, batch.column("guest").to_pylist())):
                tokens = unpack(batch.column("tokens")[i].as_py())
                if not guest:
                    meet, host = m, tokens
                    continue
                if m != meet:
                    raise ValueError(f"no set for {m}")
                at = np.minimum(np.searchsorted(host, tokens), len(host) - 1)
                if (host[at] == tokens).sum() >= limit.overlap(len(host), len(tokens)):
                    out.append((m[0], batch.column("id")[i].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()),
                                              pa.array([o[1] for o in out], pa.int64())], names=["a", "b"])

    sets = rows.mapInArrow(make, "id long, key long, tokens binary")
    sent = (sends.join(sets, ["id", "key"]).select("meet", "meet_key", "room", "guest", "id", "tokens")
            .repartition("meet", "meet_key", "room").sortWithinPartitions("meet", "meet_key", "room", "guest"))
    return materialize(sent.mapInArrow(compare, "a long, b long"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                       num: int = 3, den: int = 4) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row (ids are longs)."""
    with scratch_tables(docs.sparkSession) as tables:
        rows, groups = _components(docs, id_col, text_col, words, num, den)
        tables.keep(rows, groups)
    return (rows.select(F.col("id").alias("doc_id"), "n", "key").join(groups, ["key", "n"], "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")))


def _components(docs: DataFrame, id_col: str, text_col: str, words: int, num: int,
                den: int) -> tuple[DataFrame, DataFrame]:
    """Written tables ``id, n, key`` of every row and ``key, n, component`` of
    every class."""
    limit = Threshold(num, den)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    with scratch_tables(docs.sparkSession) as tables:  # the prefixes are only counted
        full = materialize(describe(docs, words, limit, "doc_id", "text"))
        rows = materialize(full.select("id", "n", "key"))
        classes = materialize(full.filter("n > 0 and id is not null").groupBy("key", "n")
                              .agg(F.min("id").alias("first"), F.first("sketch").alias("sketch")))
        total = full.agg(F.sum(F.octet_length("head") / 4)).first()[0] or 0
        parts = max(1, math.ceil(total / GROUP_POSTINGS),
                    int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        often, length = frequent(full, parts)
        tables.keep(rows, classes)
    light = boundary(limit, length)

    found = lists(postings(docs, words, limit, light, often, parts, "text"), limit, light)
    listed = found.filter("mark is not null")
    twos = materialize(neighbours(listed.filter(F.size("keys") == 2), limit)
                       .groupBy("x", "nx", "y", "ny").agg(F.sum("times").alias("times")))
    table = materialize(listed.filter(F.size("keys") > 2).groupBy("mark").agg(
        F.first("keys").alias("keys"), F.first("sizes").alias("sizes"), F.sum("times").alias("times")))

    def named(pairs: DataFrame, proved: bool = False) -> DataFrame:
        for side, name in (("x", "a"), ("y", "b")):
            pairs = pairs.join(classes.select(F.col("key").alias(side), F.col("n").alias(f"n{side}"),
                                              F.col("first").alias(name),
                                              *([] if proved else [F.col("sketch").alias(f"s{side}")])),
                               [side, f"n{side}"])
        if not proved:
            need = F.ceil((F.col("nx") + F.col("ny")) * F.lit(num) / F.lit(num + den))
            pairs = pairs.filter(F.col("nx") + F.col("ny") - differing(F.col("sx"), F.col("sy")) >= 2 * need)
        turn = F.col("a") > F.col("b")
        return pairs.filter("a != b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
            F.when(turn, F.col("y")).otherwise(F.col("x")).alias("x"),
            F.when(turn, F.col("x")).otherwise(F.col("y")).alias("y")).distinct()

    def grouped(edges: DataFrame) -> DataFrame:
        return materialize(classes.join(components(edges, "a", "b"), F.col("first") == F.col("id"), "left")
                           .select("key", "n", F.coalesce("component", "first").alias("component")))

    star = found.filter("mark is null").select(
        F.col("keys")[0].alias("x"), F.col("sizes")[0].alias("nx"), F.explode(F.arrays_zip("keys", "sizes")).alias("m"))
    links = named(star.select("x", "nx", F.col("m.keys").alias("y"), F.col("m.sizes").alias("ny"))
                  .filter("x != y or nx != ny").distinct(), True).select("a", "b")
    # Rows that share an id are one node, whatever their texts.
    own = rows.filter("n > 0 and id is not null").select("id", "key", "n")
    several = own.groupBy("id").agg(F.min(F.struct("key", "n")).alias("low"), F.max(F.struct("key", "n")).alias("high"))
    several = materialize(several.filter("low != high").select("id"))
    links = links.unionByName(own.join(several, "id").join(classes.select("key", "n", "first"), ["key", "n"])
                              .select(F.col("id").alias("a"), F.col("first").alias("b")))
    met = materialize(named(often_enough(neighbours(table, limit).unionByName(twos), limit)))
    links = materialize(links.unionByName(verify(docs, met, words, limit, "doc_id", "text")))
    groups = grouped(links)
    apart, turn = None, 0
    while True:  # while a round joins at least one in 500 of the components that were apart
        mixed = materialize(mixed_lists(table, groups))
        before = apart
        apart = mixed.select(F.explode("members.component").alias("c")).distinct().count()
        if apart == 0 or (before is not None and apart > before * 0.998):
            break
        fresh = materialize(named(to_hubs(mixed, limit, light, turn)).join(met, ["a", "b", "x", "y"], "left_anti"))
        links = materialize(links.unionByName(verify(docs, fresh, words, limit, "doc_id", "text")))
        met = materialize(met.unionByName(fresh))
        groups = grouped(links)
        turn += 1
    small = classes.select("key", "n", folded(F.col("sketch"), F.lit(SKETCH // 64)).alias("sketch"))
    mixed = mixed_lists(table, groups.join(small, ["key", "n"]), ["sketch"])
    last = often_enough(across(mixed, limit, light).unionByName(twos), limit)
    last = materialize(named(last).join(met, ["a", "b", "x", "y"], "left_anti"))
    if not last.isEmpty():
        groups = grouped(links.unionByName(verify(docs, last, words, limit, "doc_id", "text")))
    return rows, groups
