"""String expressions: stripping, snippets, prompt text, output cleaning,
fenced-JSON verdicts and lookup keys.  All native Spark expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "PY_SPACE", "col_of", "strip", "rstrip_dots", "snippet", "context_block",
    "user_prompt", "judge_prompt", "strip_reasoning", "strip_json_fence",
    "parse_verdict", "normalise_key", "REASONING_STARTERS", "ANSWER_BOUNDARY",
]

# The characters Python's str.strip() removes: every code point whose
# str.isspace() is true.  Built from that rule, so it is exact.
PY_SPACE = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """``str.strip()``: drop leading and trailing Unicode white space."""
    return F.btrim(col_of(c), F.lit(PY_SPACE))


def rstrip_dots(c) -> Column:
    """``str.rstrip('.')``."""
    return F.rtrim(col_of(c), F.lit("."))


def snippet(c, n: int = 280) -> Column:
    """First ``n`` characters with newlines turned into spaces."""
    return F.translate(F.substring(col_of(c), 1, n), "\n", " ")


def context_block(section_id, title, text) -> Column:
    """``[section | title]`` header line followed by the passage text."""
    return F.concat(F.lit("["), col_of(section_id), F.lit(" | "), col_of(title),
                    F.lit("]\n"), col_of(text))


# The separator between context blocks and the prompt texts.
CONTEXT_SEPARATOR = "\n\n---\n\n"
NO_CONTEXT_TEMPLATE = ("Question: ", "\n\nContext: (no relevant BNS sections retrieved)")
PROMPT_HEAD = "Context (BNS extracts):\n\n"
PROMPT_QUESTION = "\n\nQuestion: "
PROMPT_TAIL = "\n\nAnswer in the same language as the question, citing BNS sections used."


def user_prompt(question, context) -> Column:
    """User prompt from a question and its joined context (null: no hits)."""
    q, ctx = col_of(question), col_of(context)
    with_ctx = F.concat(F.lit(PROMPT_HEAD), ctx, F.lit(PROMPT_QUESTION), q, F.lit(PROMPT_TAIL))
    without = F.concat(F.lit(NO_CONTEXT_TEMPLATE[0]), q, F.lit(NO_CONTEXT_TEMPLATE[1]))
    return F.when(ctx.isNull(), without).otherwise(with_ctx)


def judge_prompt(question, expected, answer) -> Column:
    return F.concat(F.lit("Question: "), col_of(question),
                    F.lit("\nExpected BNS section: "), col_of(expected),
                    F.lit("\nCandidate answer:\n"), col_of(answer), F.lit("\n"))


# Phrases that mark a reasoning preamble when found anywhere in
# the first 200 characters (lower-cased).
REASONING_STARTERS = [
    "okay,", "okay ", "let me", "i need to", "first,", "first ",
    "looking at", "the user", "i should", "i'll", "i will",
    "to answer", "based on the context", "checking the",
]
# Fixed value: a blank line followed by an answer marker (case-insensitive).
ANSWER_BOUNDARY = (r"\n\s*\n\s*(?:\[BNS|[ऀ-ॿ]|(?:Answer|Response|उत्तर|जवाब):"
                   r"|According to|Under (?:Section|BNS))")


def strip_reasoning(c) -> Column:
    """Clean model output: text after the last ``</think>``; else, when a
    reasoning phrase opens the text and an answer boundary lies past offset
    50, the text from that boundary; else the stripped text."""
    t = strip(c)
    after_think = strip(F.regexp_replace(t, r"(?is)\A.*</think>", ""))
    head = F.lower(F.substring(t, 1, 200))
    has_starter = F.lit(False)
    for s in REASONING_STARTERS:
        has_starter = has_starter | head.contains(s)
    has_boundary = t.rlike("(?iU)" + ANSWER_BOUNDARY)
    # Characters before the first boundary (code points, as Python counts).
    before = F.regexp_extract(t, r"(?isU)\A(.*?)" + ANSWER_BOUNDARY, 1)
    from_boundary = strip(F.substring(t, F.length(before) + 1, F.lit(2 ** 31 - 1)))
    return (
        F.when(F.lower(t).contains("</think>"), after_think)
        .when(has_starter & has_boundary & (F.length(before) > 50), from_boundary)
        .otherwise(t)
    )


def strip_json_fence(c) -> Column:
    """strip, drop a leading '```json' and a trailing '```', strip again."""
    t = strip(c)
    t = F.regexp_replace(t, r"\A```json", "")
    t = F.regexp_replace(t, r"```\z", "")
    return strip(t)


def parse_verdict(c) -> Column:
    """Judge verdict -> struct(correctness int, citation int, reason string).
    Invalid JSON gives (0, 0, 'judge parse failure'); a missing or
    non-numeric score counts 0; numbers are cut toward zero."""
    v = F.try_parse_json(strip_json_fence(c))

    def score(key: str) -> Column:
        x = F.try_variant_get(v, f"$.{key}", "double")
        return F.coalesce(x.try_cast("int"), F.lit(0))

    return F.when(
        v.isNull(),
        F.struct(F.lit(0).alias("correctness"), F.lit(0).alias("citation"),
                 F.lit("judge parse failure").alias("reason")),
    ).otherwise(
        F.struct(score("correctness").alias("correctness"), score("citation").alias("citation"),
                 F.try_variant_get(v, "$.reason", "string").alias("reason"))
    )


def normalise_key(c) -> Column:
    """Lookup key: strip, drop leading zeros (empty -> '0'), lower-case."""
    k = F.ltrim(strip(col_of(c).cast("string")), F.lit("0"))
    return F.lower(F.when(k == "", F.lit("0")).otherwise(k))
