"""URL verdicts: host and path rules, then a multinomial naive Bayes model
over segmented host names and path tokens.

A host label such as ``thetiongroup`` is cut by unigram Viterbi: the cheapest
split under the word counts of the pages' own text (without its markup), where
an unknown letter costs more than any word.  Words of every length count; only
substrings of the distinct labels that have the length of some word are looked
up, by a join with the word counts, and labels are segmented once each.  The model learns from the urls that a rule decides and judges the
others: token weights are summed per distinct host and per distinct path
shape (digits as one token), which pages then look up.

Null urls and urls without ``://`` have an empty host and path and fit no
rule; they get the prior's verdict, allow on a tie or without training rows.
Repeated rows get equal verdicts.  An empty table gives an empty table.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from quarry.llm.batches import per_text
from quarry.llm.words import word_hashes
from quarry.session import materialize

Rule = tuple[str, str, str]  # host, path, verdict
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTER = np.zeros(256, bool)
_LETTER[ord("a"):ord("z") + 1] = _LETTER[ord("A"):ord("Z") + 1] = True


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule whose host is ``host`` or a parent domain of it and
    whose path starts ``path``: ``struct<size, rule, verdict>`` or null.  The
    host's own parent domains are looked up in the rules, so the cost follows
    the depth of the name, not the number of rules."""
    by_host: dict[str, list[tuple[str, str]]] = {}
    for h, p, verdict in rules:
        by_host.setdefault(h, []).append((p, verdict))
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    table = F.create_map(*[x for h, found in sorted(by_host.items()) for x in (
        F.lit(h), F.array(*[F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"),
                                     F.lit(v).alias("verdict"), F.lit(p).alias("path"))
                            for p, v in sorted(found)]))])
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.flatten(F.transform(parents, lambda h: F.filter(
        F.coalesce(F.element_at(table, h), F.array().cast(
            "array<struct<size:int,rule:string,verdict:string,path:string>>")),
        lambda r: F.startswith(path, r["path"]))))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["size"], r["rule"], r["verdict"])))


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """``hash, size, n`` of the runs of ASCII letters in all texts,
    lower-cased; counted inside each slice before the shuffle."""
    def count(buf, off):
        word = np.concatenate([[False], _LETTER[buf], [False]])
        edge = np.zeros(len(buf) + 1, bool)
        edge[off] = True
        starts = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
        ends = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
        hashes, one, n = np.unique(word_hashes(buf, starts, ends), return_index=True, return_counts=True)
        rows = len(off) - 1  # all counts of a slice go with its first row
        first = np.concatenate([[0], np.full(rows, len(hashes))]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x.astype(np.int64)))
                for x in (hashes, (ends - starts)[one], n)]

    lists = ArrayType(LongType())
    per_slice = per_text(texts, text_col, [], [StructField(c, lists) for c in ("hash", "size", "n")], count)
    return (per_slice.select(F.explode(F.arrays_zip("hash", "size", "n")).alias("x"))
            .groupBy("x.hash").agg(F.max("x.size").alias("size"), F.sum("x.n").alias("n")))


def without_markup(text: Column) -> Column:
    """A page's text: scripts, styles, comments and tags count as a space."""
    return F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def cut(letters: str, costs: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """The cheapest split; on equal cost the one with the longest last word."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for (start, end), cost in sorted(costs.items()):
        ending.setdefault(end, []).append((start, cost))
    best, back = [0.0] + [math.inf] * len(letters), [0] * (len(letters) + 1)
    for end in range(1, len(letters) + 1):
        steps = ending.get(end, [])
        if (end - 1, end) not in costs:
            steps = [*steps, (end - 1, unknown)]
        for start, cost in steps:
            if best[start] + cost < best[end]:
                best[end], back[end] = best[start] + cost, start
    words, end = [], len(letters)
    while end:
        words.append(letters[back[end]:end])
        end = back[end]
    return words[::-1]


def segment(names: DataFrame, counts: DataFrame, name_col: str = "name") -> DataFrame:
    """``name, words`` for a table of distinct letter runs.  The lengths that
    words have are few numbers (their sum is at most the bytes of all words)."""
    longest = int(names.agg(F.max(F.octet_length(name_col))).first()[0] or 0)
    length = np.array(sorted(r["size"] for r in counts.filter(F.col("size") <= longest).select("size").distinct().collect()),
                      np.int64)

    def pieces(buf, off):
        size = np.diff(off)
        at = np.concatenate([np.arange(a, b) for a, b in zip(off[:-1], off[1:])] or [np.zeros(0, np.int64)])
        row = np.repeat(np.arange(len(size)), size)
        ok = at[:, None] + length[None, :] <= off[1:][row][:, None]
        start = np.repeat(at, ok.sum(1))
        end = start + np.tile(length, (len(at), 1))[ok]
        hashes = word_hashes(buf, start, end).astype(np.int64)
        owner = np.repeat(row, ok.sum(1))
        cuts = np.searchsorted(owner, np.arange(len(size) + 1)).astype(np.int32)
        base = off[:-1][owner]
        return [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x))
                for x in (hashes, (start - base).astype(np.int64), (end - base).astype(np.int64))]

    lists = ArrayType(LongType())
    found = per_text(names, name_col, [name_col],
                     [StructField(c, lists) for c in ("hash", "start", "stop")], pieces)
    found = found.select(name_col, F.explode(F.arrays_zip("hash", "start", "stop")).alias("x"))
    total = float(counts.agg(F.sum("n")).first()[0] or 0) + 1.0
    known = (found.join(counts, F.col("x.hash") == F.col("hash"))
             .groupBy(name_col).agg(F.collect_list(F.struct("x.start", "x.stop", "n")).alias("found")))
    unknown = math.log(total) + math.log(1000.0)

    def split(batches):
        for batch in batches:
            words = []
            for name, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                costs = {(s["start"], s["stop"]): math.log(total / s["n"]) for s in spans or []}
                words.append(cut(name, costs, unknown))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.list_(pa.string()))], names=[name_col, "words"])

    return (names.join(known, name_col, "left").select(name_col, "found")
            .mapInArrow(split, f"{name_col} string, words array<string>"))


def token_weights(hosts: DataFrame, shapes: DataFrame) -> tuple[DataFrame, float]:
    """From ``tokens, n_block, n_allow`` tables the weight of each token,
    ``log p(token | block) - log p(token | allow)`` with one added to every
    count, and the weight of a token never seen (they are both per row)."""
    seen = (hosts.unionByName(shapes).select(F.explode("tokens").alias("token"), "n_block", "n_allow")
            .groupBy("token").agg(F.sum("n_block").alias("b"), F.sum("n_allow").alias("a")).filter("a + b > 0"))
    seen = materialize(seen)
    n = seen.agg(F.count(F.lit(1)).alias("v"), F.sum("b").alias("b"), F.sum("a").alias("a")).first()
    b, a = float(n["b"] or 0) + n["v"] + 1.0, float(n["a"] or 0) + n["v"] + 1.0
    return seen.select("token", (F.log((F.col("b") + 1) / F.lit(b))
                                 - F.log((F.col("a") + 1) / F.lit(a))).alias("w")), math.log(a / b)


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url",
          text_col: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row; ``score``
    is the model's log-odds of block."""
    host, path = host_and_path(F.col(f"`{url_col}`"))
    urls = (pages.select(F.col(f"`{id_col}`").alias("page_id"), F.coalesce(host, F.lit("")).alias("host"),
                         F.coalesce(path, F.lit("")).alias("path"))
            .withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
            .withColumn("shape", F.regexp_replace(F.translate("path", UPPER, LOWER), "[0-9]+", "0")))
    urls = materialize(urls)
    votes = [F.sum((F.col("fit.verdict") == v).cast("long")).alias(f"n_{v}") for v in ("block", "allow")]
    zero = {"n_block": 0, "n_allow": 0}
    hosts = urls.groupBy("host").agg(*votes).fillna(zero)
    shapes = (urls.groupBy("shape").agg(*votes).fillna(zero)
              .withColumn("tokens", F.regexp_extract_all("shape", F.lit("[a-z0-9]+|[^\\x00-\\x7F]+"), 0)))

    runs = hosts.withColumn("runs", F.regexp_extract_all(
        "host", F.lit("[a-z]+|[0-9]+|[^a-z0-9.\\-]+"), 0))
    names = runs.select(F.explode("runs").alias("name")).filter(F.col("name").rlike(r"\A[a-z]+\z")).distinct()
    names = materialize(names)
    text = pages.select(without_markup(F.col(f"`{text_col}`")).alias("text"))
    words = materialize(segment(names, materialize(word_counts(text, "text"))))
    cutup = (runs.select("host", F.posexplode("runs").alias("pos", "name"))
             .join(words, "name", "left")
             .withColumn("words", F.coalesce("words", F.array(F.regexp_replace("name", "[0-9]+", "0"))))
             .groupBy("host").agg(F.sort_array(F.collect_list(F.struct("pos", "words"))).alias("t")))
    hosts = materialize(hosts.join(cutup, "host", "left").withColumn(
        "tokens", F.coalesce(F.flatten(F.col("t.words")), F.array().cast("array<string>"))).drop("t"))

    weights, unseen = token_weights(hosts.select("tokens", "n_block", "n_allow"),
                                    shapes.select("tokens", "n_block", "n_allow"))

    def scored(rows: DataFrame, key: str) -> DataFrame:
        return (rows.select(key, F.explode("tokens").alias("token")).join(weights, "token", "left")
                .groupBy(key).agg(F.sum(F.coalesce("w", F.lit(unseen))).alias(f"{key}_score")))

    n = hosts.agg(F.sum("n_block").alias("b"), F.sum("n_allow").alias("a")).first()
    prior = math.log((float(n["b"] or 0) + 1.0) / (float(n["a"] or 0) + 1.0))
    score = (F.lit(prior) + F.coalesce("host_score", F.lit(0.0)) + F.coalesce("shape_score", F.lit(0.0)))
    # Written first, so that both sides of each join are plain exchanges and
    # AQE can split a host or shape that holds a large share of the pages.
    by_host, by_shape = materialize(scored(hosts, "host")), materialize(scored(shapes, "shape"))
    return (urls.join(by_host, "host", "left").join(by_shape, "shape", "left")
            .withColumn("score", score)
            .select("page_id", "host", "path", F.col("fit.rule").alias("rule"),
                    F.coalesce(F.col("fit.verdict"), F.when(F.col("score") > 0, "block").otherwise("allow"))
                    .alias("verdict"), "score"))
