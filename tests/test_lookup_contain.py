"""Key lookups (JOIN-4/5, WIN-3) and exact containment."""
import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarry.operators.contain import containing
from quarry.operators.lookup import first_per_key, list_all, lookup, unmatched

MAP = [("304A", "Snatching", 0), ("0420", "Cheating", 1), ("420", "Dup later", 2), ("N/A", "New offence", 3),
       ("N/A", "Another new", 4), ("0", "Zero", 5), ("303(1)", "Paren", 6)]


def test_lookup_first_row_wins_and_unmatched(spark):
    m = spark.createDataFrame(MAP, "ipc_section string, ipc_title string, map_ord long")
    mapping = first_per_key(m, F.col("ipc_section"), "map_ord")
    keys = spark.createDataFrame([(1, " 0420 "), (2, "304a"), (3, "000"), (4, "N/A"), (5, "999"), (6, "303(1)")],
                                 "qid long, k string")
    got = {r.qid: r.ipc_title for r in lookup(keys, "k", mapping).collect()}
    assert got == {1: "Cheating", 2: "Snatching", 3: "Zero", 4: "New offence", 6: "Paren"}
    assert [r.k for r in unmatched(keys, "k", mapping).collect()] == ["999"]
    assert [r.map_ord for r in list_all(m, ["ipc_section", "map_ord"], "map_ord").collect()] == list(range(7))


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([1 << 20, 300]))
def test_containing_matches_brute_force(spark, seed, block_bytes):
    rnd = random.Random(seed)
    alpha = "ab cé"
    hay = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 120))) for _ in range(12)]
    needles = []
    for i in range(10):
        if i % 2 and hay[i]:
            h = hay[i]
            a = rnd.randint(0, len(h) - 1)
            needles.append(h[a:a + rnd.randint(1, 40)])
        else:
            needles.append("".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 35))))
    n = spark.createDataFrame(list(enumerate(needles)), "needle_id long, needle string")
    h = spark.createDataFrame(list(enumerate(hay)), "doc_id long, text string")
    got = {(r.needle_id, r.doc_id) for r in containing(n, h, block_bytes=block_bytes).collect()}
    want = {(i, j) for i, nd in enumerate(needles) for j, t in enumerate(hay) if nd and nd in t}
    assert got == want


def test_containing_with_any_ids_and_edges(spark):
    from decimal import Decimal

    n = spark.createDataFrame([(Decimal("1.5"), "theft of"), (Decimal("2"), ""), (Decimal("3"), None), (Decimal("4"), "x"),
                               (Decimal("5"), "theft of"), (None, "x")], "needle_id decimal(5,1), needle string")
    h = spark.createDataFrame([("a", "the theft of goods"), ("b", None), ("c", ""), (None, "x"), ("d", "y" * 300_000 + "x")],
                              "doc_id string, text string")
    got = {(None if r[0] is None else float(r[0]), r[1]) for r in containing(n, h).collect()}
    assert got == {(1.5, "a"), (5.0, "a"), (4.0, None), (4.0, "d"), (None, None), (None, "d")}
    assert containing(n.limit(0), h).count() == 0 and containing(n, h.limit(0)).count() == 0


def test_shared_beginnings_cost_no_more():
    """Needles that share a long beginning: table lookups stay in proportion
    to the text, whatever their number."""
    import numpy as np
    from quarry.operators import contain

    looked = []

    class Counted(contain.Hashed):
        def of(self, start, size):
            looked.append(len(start))
            return super().of(start, size)

    cost = []
    for n in (100, 1000):
        needles = [f"What is the meaning of case {i}?".encode() for i in range(n)]
        text = b" ".join(needles[:100]) + b" What is the"
        block = contain.Needles(needles)
        raw = np.frombuffer(text, np.uint8)
        looked.clear()
        kept, contain.Hashed = contain.Hashed, Counted
        try:
            rows, found = block.search(raw, np.array([0, len(raw)]))
        finally:
            contain.Hashed = kept
        assert found.tolist() == list(range(100))
        cost.append(sum(looked))
    assert cost[1] <= cost[0] * 2


def test_nested_needles_are_all_found():
    import numpy as np
    from quarry.operators.contain import Needles

    texts = [b"a", b"ab", b"abc", b"abcdefghij", b"abcdefghijkl", b"bc", b"zz"]
    rows, found = Needles(texts).search(np.frombuffer(b"xabcdefghijkbcab", np.uint8), np.array([0, 12, 16]))
    want = [(r, i) for r, t in enumerate([b"xabcdefghijk", b"bcab"]) for i, n in enumerate(texts) if n in t]
    assert list(zip(rows.tolist(), found.tolist())) == want


def test_flags_from_rows_of_right_ids(spark):
    from quarry.operators.evaluate import hit_flags

    items = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 6, "d"), (3, 1, "e")],
                                 "query_id long, rank int, section_id string")
    right = spark.createDataFrame([(1, "b"), (1, "zz"), (1, "b"), (2, "d"), (2, "q"), (3, "e"), (4, "y")],
                                  "query_id long, expected_id string")
    got = {r.query_id: (r.retrieved, r.expected_found, r.in_top_5, r.in_top_1)
           for r in hit_flags(items, hits, "query_id", right).collect()}
    assert got == {1: (["a", "b"], ["b"], True, False), 2: (["c", "d"], ["d"], False, False),
                   3: (["e"], ["e"], True, True), 4: ([], ["y"], False, False)}
