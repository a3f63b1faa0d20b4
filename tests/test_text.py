"""Scalar text expressions: stripping, output cleaning, verdicts, keys."""
import pytest
from pyspark.sql import functions as F

from quarry.functions.text import normalise_key, parse_verdict, snippet, strip, strip_reasoning

# Model output and what cleaning must leave.
CLEAN_CASES = [
    ("<think>plan</think>\nThe answer.", "The answer."),
    ("<THINK>a</THINK> B", "B"),
    ("<think>a</think> x <think>b</think>  final ", "final"),
    ("<think>never closed, answer here", "<think>never closed, answer here"),
    ("Okay, let me check the context for the relevant section of the law here.\n\n[BNS Section 303] Theft ...",
     "[BNS Section 303] Theft ..."),
    ("Okay, so.\n\nAnswer: short preamble", "Okay, so.\n\nAnswer: short preamble"),
    ("Let me think about it, the relevant passage is in the context above, yes indeed.\nno boundary",
     "Let me think about it, the relevant passage is in the context above, yes indeed.\nno boundary"),
    ("I need to answer in Hindi, so I will reply in the user's language as requested here.\n\nचोरी की सज़ा ...",
     "चोरी की सज़ा ..."),
    ("Under Section 303, theft is punished. The user asked about this earlier.",
     "Under Section 303, theft is punished. The user asked about this earlier."),
    ("Plain answer without any preamble.", "Plain answer without any preamble."),
    ("  First, note that...\n\n   According to the context the rule is clear, and this is long enough.\n\nAccording to BNS",
     "First, note that...\n\n   According to the context the rule is clear, and this is long enough.\n\nAccording to BNS"),
    ("the user wants a summary of the punishment for this offence\n \n उत्तर: तीन वर्ष", "उत्तर: तीन वर्ष"),
    ("x" * 210 + " okay, \n\nAnswer: late phrase", "x" * 210 + " okay, \n\nAnswer: late phrase"),
    ("", ""),
]


def test_strip_reasoning_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEAN_CASES)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", strip_reasoning("t").alias("c")).collect()}
    for i, (text, want) in enumerate(CLEAN_CASES):
        assert got[i] == want, (i, text)


def test_strip_unicode_spaces(spark):
    s = "   text 　\n\x1c"
    df = spark.createDataFrame([(s,)], "t string")
    assert df.select(strip("t").alias("x")).first().x == s.strip()
    df = spark.createDataFrame([("a\nb" * 200,)], "t string")
    assert df.select(snippet("t").alias("x")).first().x == ("a\nb" * 200)[:280].replace("\n", " ")


VERDICTS = [
    ('{"correctness": 4, "citation": 1, "reason": "ok"}', (4, 1, "ok")),
    ('```json\n{"correctness": 3, "citation": 0, "reason": "r"}\n```', (3, 0, "r")),
    ('```\n{"correctness": 3}\n```', (0, 0, "judge parse failure")),
    ('{"correctness": 4', (0, 0, "judge parse failure")),
    ('{"citation": 1}', (0, 1, None)),
    ('{"correctness": 4.5, "citation": 1}', (4, 1, None)),
    ('[1, 2]', (0, 0, None)),
]


def test_parse_verdict(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(VERDICTS)], "i int, v string")
    got = {r.i: (r.j.correctness, r.j.citation, r.j.reason)
           for r in df.select("i", parse_verdict("v").alias("j")).collect()}
    for i, (raw, want) in enumerate(VERDICTS):
        assert got[i] == want, raw


@pytest.mark.parametrize("key,want", [(" 0420 ", "420"), ("304a", "304a"), ("304A", "304a"), ("000", "0"),
                                      ("N/A", "n/a"), ("0", "0"), ("12", "12")])
def test_normalise_key(spark, key, want):
    df = spark.createDataFrame([(key,)], "k string")
    assert df.select(normalise_key("k").alias("x")).first().x == want
