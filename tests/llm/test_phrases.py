import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quarry.llm import phrases as module
from quarry.llm.phrases import phrases, ranked, supports

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, support, longest, share, top):
    counts, words = {}, Counter()
    for _, text, lang in rows:
        lang = lang if lang is not None else "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = set()
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        rows = []
        for p, a in candidates.items():
            longer = [n for q, n in candidates.items() if len(q) > len(p)
                      and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * n >= share * a for n in longer):
                continue
            score, _, le, r = min((1_000_000 * a * a // (f[p[:c]] * f[p[c:]]), c, f[p[:c]], f[p[c:]])
                                  for c in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), le, r))
        for rank, (score, a, phrase, le, r) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, le, r, words[lang], -score))
    return out


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = ["New", "york", "é", "Ärger", "deep", "net", "x.y", "a", "b", "c"] + [f"w{i}" for i in range(30)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab[:rng.choice([4, 12, 40])]) for _ in range(rng.choice([0, 1, 3, 30, 90]))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!", "   "]) for w in words)
        rows.append((i if i % 9 else None, text if i % 13 else None, rng.choice(["en", "en", "de", None, "und", ""])))
    rows.append((1, "new york " * 3000, "en"))  # one very long text
    return rows + rows[:30]


def found(df):
    return {tuple(r) for r in df.collect()}


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(module, "SLICE", 2000)
    for seed, support, longest, shards in [(1, 4, 3, 4), (2, 3, 4, 2), (3, 10, 2, 9)]:
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
        got = found(phrases(docs, support=support, longest=longest, top=40, shards=shards))
        assert got and got == plain(rows, support, longest, 50, 40)


def test_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr("quarry.llm.packed.MAX_BITS", 1 << 10)  # lets nearly every run pass
    rows = corpus(4)
    got = found(phrases(spark.createDataFrame(rows, SCHEMA), support=5, top=30))
    assert got == plain(rows, 5, 3, 50, 30)


def test_large_products_stay_exact(spark):
    counts = spark.createDataFrame([("en", 1, "a", 4_000_000_000_037), ("en", 1, "b", 3_999_999_999_989),
                                    ("en", 2, "a b", 3_999_999_999_981)], "lang string, k int, phrase string, n long")
    row = module.scored(counts).first()
    assert row.score == 1_000_000 * row.a ** 2 // (row.l * row.r)
    assert row.a ** 2 > 2 ** 64


def test_local_supports_cover_the_global_one(spark):
    docs = spark.createDataFrame([(0, "x" * 700), (1, "y" * 200), (2, "z" * 101)], "shard int, text string")
    local, size = supports(docs, 4, 10)
    assert size == 1001 and local == [7, 2, 2, 1]
    assert sum(n - 1 for n in local) < 10  # a phrase under all of them is under the global support


def test_ranks_over_many_partitions(spark):
    rows = [("en" if i % 3 else "de", i % 50, f"p{i:04d}") for i in range(3000)]
    got = found(ranked(spark.createDataFrame(rows, "lang string, score int, phrase string").repartition(7),
                       [F.desc("score"), F.asc("phrase")], 700).select("lang", "score", "phrase", "rank"))
    want = set()
    for lang in ("en", "de"):
        mine = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[1], r[2]))[:700]
        want |= {(*r, i) for i, r in enumerate(mine, 1)}
    assert got == want


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert phrases(empty).count() == 0
    assert phrases(spark.createDataFrame([(1, None, None), (2, "", "en"), (3, " ., ", "en")], SCHEMA)).count() == 0
    clash = spark.createDataFrame([("a b " * 12, "en", 5, 1, "x", 7)], "text string, lang string, n int, k int, phrase string, rank int")
    assert found(phrases(clash)) == plain([(1, "a b " * 12, "en")], 10, 3, 50, 2000)
