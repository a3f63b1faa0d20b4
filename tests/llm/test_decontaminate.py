import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.llm.decontaminate import Items, align, leaks


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i + 1, j] - 1, h[i, j + 1] - 1)
    return h.max()


def test_alignment_equals_the_plain_table():
    rng = np.random.default_rng(0)
    a = [rng.integers(0, 6, rng.integers(0, 14)).astype(np.uint64) for _ in range(60)]
    b = [rng.integers(0, 6, rng.integers(0, 22)).astype(np.uint64) for _ in range(60)]
    assert align(a, b).tolist() == [smith_waterman(x, y) for x, y in zip(a, b)]


def tables(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    items = {i: [word() for _ in range(rng.randint(12, 40))] for i in range(30)}
    rows, want = [], set()
    for d in range(300):
        w = [word() for _ in range(rng.randint(5, 200))]
        if d % 3 == 0:  # a third holds one item, exact or with every eighth word changed
            i = 0 if d % 2 else rng.randrange(30)
            copy = list(items[i])
            if d % 4 == 0:
                for k in range(5, len(copy), 8):
                    copy[k] = word()
            at = rng.randrange(len(w))
            w[at:at] = copy
            want.add((d, i))
        rows.append((d, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "Tiny  ITEM here"), (None, " ".join(items[3])), (503, " ".join(items[4][:4]))]
    want |= {(502, 99), (None, 3)}
    bench = [(i, " ".join(w)) for i, w in items.items()] + [(99, "tiny item"), (98, None), (97, ""), (None, "x y z u v")]
    return (spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("item", F.lit(0)),
            spark.createDataFrame(bench, "item_id int, text string"), want)


def test_planted_items_are_found_and_clean_documents_left(spark):
    docs, bench, want = tables(spark)
    got = leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(0.5 <= r.score <= 1 and r.start < r.stop for r in got)
    blocks = leaks(docs, bench, block_bytes=10_000).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, got))


def test_empty_tables(spark):
    docs, bench, _ = tables(spark)
    assert leaks(docs.limit(0), bench).count() == 0
    assert leaks(docs, bench.limit(0)).count() == 0


def test_copies_of_few_seeds_are_found_however_frequent(spark):
    long = [f"w{i}" for i in range(16)]
    edited = [f"x{i}" if i in (2, 5, 8, 12, 15) else w for i, w in enumerate(long)]
    items = [(0, " ".join(long)), (1, "one two three four"), (2, "tiny pair"), (3, "the same common phrase of many documents ends here")]
    texts = [" ".join(edited), "says one two three four here", "a tiny pair", "said the same common phrase again"]
    rows = [(100 * k + d, f"before{d} {t} after{d}") for k, t in enumerate(texts) for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in leaks(docs, spark.createDataFrame(items, "item_id int, text string")).collect()}
    edited_score = smith_waterman([int(w[1:]) for w in long], [int(w[1:]) + 100 * (w[0] == "x") for w in edited]) / 32
    want = {(100 * k + d, k): (edited_score, 1, 1)[k] for k in range(3) for d in range(60)}
    assert edited_score >= 0.5 and got == want | {k: v for k, v in got.items() if k[1] == 3 and v >= 0.5}
    words = [i[1].split() for i in items]
    score = smith_waterman([hash(w) for w in words[3]], [hash(w) for w in texts[3].split()]) / (2 * len(words[3]))
    assert ((300, 3) in got) == (score >= 0.5)


def test_common_words_bound_every_alignment():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9, rng.integers(1, 15))) for _ in range(40)]
    items = Items(list(range(40)), texts, 3)
    for lo, hi in ((0, len(items.words)), (7, 9), (5, 30)):
        words = items.words[lo:hi]
        n = items.shared(items.words, np.arange(40), np.full(40, lo), np.full(40, hi))
        own = [items.words[items.woff[i]:items.woff[i + 1]] for i in range(40)]
        assert n.tolist() == [(Counter(o.tolist()) & Counter(words.tolist())).total() for o in own]
        assert all(align(own, [words] * 40) <= 2 * n)


def test_edited_copies_are_found_by_share_of_changed_words(spark):
    """Against a plain alignment of every copy: whatever scores and keeps a
    run of three words is found; the seeds lose only copies without one."""
    rng = random.Random(9)
    items, rows, score, run = {}, [], {}, {}
    for d in range(750):
        share = (0.1, 0.2, 0.3, 0.4, 0.5)[d % 5]
        item = items.setdefault(d % 150, [f"i{d % 150}w{j}" for j in range(rng.randint(12, 40))])
        changed = [rng.random() < share for _ in item]
        copy = [f"d{d}x{j}" if c else w for j, (w, c) in enumerate(zip(item, changed))]
        around = [f"d{d}y{j}" for j in range(30)]
        rows.append((d, " ".join(around[:15] + copy + around[15:])))
        score[d] = smith_waterman(item, copy) / (2 * len(item))
        run[d] = "000" in "".join(str(int(c)) for c in changed)
    got = {r.doc_id: (r.item_id, r.score) for r in leaks(
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id int, text string")).collect()}
    scoring = {d for d, s in score.items() if s >= 0.5}
    assert {d for d in scoring if run[d]} == set(got)
    assert all(got[d] == (d % 150, score[d]) for d in got)
    recall = [(sum(d in got for d in of), len(of)) for k in range(5) for of in [[d for d in scoring if d % 5 == k]]]
    print("found of scoring copies, by share of changed words:", recall)
    assert recall[0][0] == recall[0][1] and sum(f for f, _ in recall) >= 0.99 * sum(n for _, n in recall)
