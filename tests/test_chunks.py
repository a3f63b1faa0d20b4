"""Character windows (GEN-3, 5, 6)."""
import time

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarry.operators.chunks import char_chunks, check_window


def chunks_of(spark, texts, tokens, overlap):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "section_id string, text string")
    rows = char_chunks(df, tokens, overlap).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.section_id, r.chunk_index)):
        got.setdefault(int(r.section_id), []).append(r)
    return got


def test_window_edges(spark):
    # width 8, step 4 at tokens=2, overlap=1
    got = chunks_of(spark, ["", "abc", "a" * 8, "abcdefghijkl", "abcdefghijklm", "été" * 5], 2, 1)
    assert 0 not in got
    assert {i: [r.text for r in rows] for i, rows in got.items()} == {
        1: ["abc"], 2: ["a" * 8], 3: ["abcdefgh", "efghijkl"], 4: ["abcdefgh", "efghijkl", "ijklm"],
        5: ["étéétéét", "téétéété", "éétéété"]}
    assert got[4][0].chunk_id == "4::chunk_0000"


def test_wide_overlap(spark):
    # width 16, step 4: a window spans four steps
    got = chunks_of(spark, ["abcdefghijklmnopqrstuvw"], 4, 3)
    assert [r.text for r in got[0]] == ["abcdefghijklmnop", "efghijklmnopqrst", "ijklmnopqrstuvw"]


def test_overlap_zero_and_guard(spark):
    got = chunks_of(spark, ["abcdefghij" * 3], 2, 0)
    assert "".join(r.text for r in got[0]) == "abcdefghij" * 3
    with pytest.raises(ValueError):
        check_window(4, 4)
    with pytest.raises(ValueError):
        char_chunks(spark.createDataFrame([("a", "x")], "section_id string, text string"), 4, 5)


def test_index_above_9999(spark):
    got = chunks_of(spark, ["x" * 40_010], 1, 0)  # width 4, step 4
    ids = [r.chunk_id for r in got[0]]
    assert ids[9999] == "0::chunk_9999" and ids[10000] == "0::chunk_10000"


@settings(max_examples=20, deadline=None)
@given(st.text(st.characters(codec="utf-8"), min_size=1, max_size=300), st.integers(1, 6), st.integers(0, 5))
def test_windows_cover_the_text(spark, text, tokens, overlap):
    if overlap >= tokens:
        return
    width, step = tokens * 4, (tokens - overlap) * 4
    got = [r.text for r in chunks_of(spark, [text], tokens, overlap)[0]]
    assert got[0] + "".join(t[width - step:] for t in got[1:]) == text
    assert all(len(t) == width for t in got[:-1]) and 0 < len(got[-1]) <= width
    assert len(got) == 1 or len(got[-1]) > width - step  # no window repeats what the one before it ends with


def test_combining_marks_count_as_characters(spark):
    # e and a combining acute accent are two characters
    got = chunks_of(spark, ["cafe\u0301 bar"], 1, 0)
    assert [r.text for r in got[0]] == ["cafe", "\u0301 ba", "r"]


def test_time_grows_with_the_length(spark):
    """One long text: twice the characters take about twice the time."""
    def seconds(n):
        df = spark.range(1).select(F.lit("s").alias("section_id"),
                                   F.expr(f"repeat('abcdefgh', {n // 8})").alias("text"))
        t0 = time.time()
        char_chunks(df, 512, 64).write.format("noop").mode("overwrite").save()
        return time.time() - t0

    seconds(1_000_000)
    four = min(seconds(4_000_000) for _ in range(2))
    assert min(seconds(8_000_000) for _ in range(2)) < 3 * four + 0.5
