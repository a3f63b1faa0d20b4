import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import substrings as module
from quarry.llm.batches import text_buffer
from quarry.llm.substrings import Block, Parsed, parse, remove_repeats, sliding

import pyarrow as pa

SCHEMA = "doc_id long, text string"
WORD = r"[^\x20\x09-\x0D]+"


def plain(rows, window):
    """Rows in order of (id, null last); rows that share an id are one text
    here (tests of other rows that share an id compare sums)."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = re.findall(WORD, text or "")
        keep = [True] * len(w)
        for a in range(len(w) - window + 1):
            key = tuple(w[a:a + window])
            if key in seen:
                keep[a:a + window] = [False] * window
            seen.add(key)
        kept = " ".join(x for x, k in zip(w, keep) if k)
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def found(df):
    return Counter(tuple(r) for r in df.collect())


def corpus(seed, n=120, vocab=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocab)] + ["É", "a.b", "ß"]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 80))] for _ in range(8)]
    rows, texts = [], []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice([[rng.choice(words) for _ in range(rng.randint(1, 40))], rng.choice(passages),
                             rng.choice(passages)[rng.randint(0, 10):], ["x"] * rng.randint(1, 50),
                             rng.choice(texts or [[]])[rng.randint(0, 9):]])
        texts.append(w)
        rows.append((rng.randrange(10**6) * 200 + i, rng.choice([" ", "  ", "\t", "\n"]).join(w)))
    rows.append((1, " ".join(rng.choice(words) for _ in range(20000))))  # one very long text
    rows.append((2, rows[-1][1]))
    return rows


@pytest.mark.parametrize("seed,window,anchor,block", [(1, 20, 8, 900), (2, 20, 8, 4 << 20), (3, 6, 3, 300),
                                                      (4, 5, 5, 2000)])
def test_equals_brute_force(spark, monkeypatch, seed, window, anchor, block):
    monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(module, "LOAD", block)
    monkeypatch.setattr(module, "SLICE", 3000)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert found(remove_repeats(docs, window=window, anchor=anchor)) == plain(rows, window)


def test_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr("quarry.llm.packed.MAX_BITS", 1 << 10)
    rows = corpus(7)
    assert found(remove_repeats(spark.createDataFrame(rows, SCHEMA))) == plain(rows, 20)


def test_nulls_empty_and_repeated_rows(spark):
    text = " ".join(f"v{i}" for i in range(45))
    rows = [(5, text), (5, text), (5, text), (7, "a " + text), (8, None), (8, ""), (9, "short"), (9, "short"),
            (None, text + " z"), (None, None), (None, "only here " * 3)]
    got = found(remove_repeats(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows, 20) and sum(got.values()) == len(rows)


def test_other_texts_with_one_id(spark):
    text = " ".join(f"v{i}" for i in range(30))
    rows = [(5, text + " q"), (5, "q " + text)]
    got = sorted((r.n_words, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(31, 0), (31, 30)]  # one of the two keeps the passage


def test_empty_and_clashing_columns(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = corpus(9, 20)
    clash = spark.createDataFrame([(*r, 1, 2, "s", 3) for r in rows],
                                  SCHEMA + ", nid long, digest int, starts string, n int")
    assert found(remove_repeats(clash)) == plain(rows, 20)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(3)
    shared = " ".join(f"s{rng.randrange(50)}" for _ in range(20))
    parts = []
    for i in range(2):
        buf, off = text_buffer(pa.array([f"{' '.join(f'{i}x{j}' for j in range(13 + i))} {shared} {i}y {i}z"]))
        parsed = Parsed(buf, off, 20)
        least, places = parsed.anchors(8)
        parts.append(int(least[13 + i]))
        assert parts[-1] in places.tolist()
    assert parts[0] == parts[1]


def test_sliding():
    x = np.random.default_rng(1).integers(0, 99, 200)
    for width in (1, 2, 5, 8, 13):
        want = [x[i:i + width].min() for i in range(len(x) - width + 1)]
        assert sliding(x, width, np.minimum).tolist() == want


def test_factors_meet_at_their_boundaries():
    """Two passages of a block follow each other in another order: windows
    across the seam are literals, all others lie in factors."""
    def block(texts):
        buf, off = text_buffer(pa.array(texts))
        return Block({"block": 0, "nids": bytes(8 * len(texts)), "digests": bytes(8 * len(texts)),
                      "starts": bytes(8 * len(texts)), "off": off.tobytes(), "text": buf.tobytes()}, 4)

    held = block(["a b c d e f g", "p q r s t"])
    buf, off = text_buffer(pa.array(["x p q r s t a b c d e f g y"]))
    p = Parsed(buf, off, 4)
    assert parse(p, 0, 14, held.find(p.hashes()), held) == [(1, 6), (6, 13)]
