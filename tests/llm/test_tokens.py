import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from quarry.llm.queries import vocabulary_path
from quarry.llm.tokens import load_sentencepiece, token_counts

EDGE = ["", " ", "  a  ", "日本語テキスト 梦  \U0001F600\U0001F600x", "a▁b", "\n\n\tx", "x" * 300,
        "é" * 100 + "\U0001F680" * 90, "ab" * 40_000, " the", "the "]


def library(pieces, scores, fallback):
    vocab = [("<unk>", min(scores))] + list(zip(pieces, scores))
    vocab += [(f"<0x{i:02X}>", -1e5) for i in range(256)] if fallback else []
    t = Tokenizer(models.Unigram(vocab, 0, fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


@pytest.mark.parametrize("fallback", [True, False])
def test_counts_equal_the_tokenizer(spark, fallback):
    pieces, scores, _ = load_sentencepiece(vocabulary_path())
    rng = random.Random(3)
    texts = EDGE + ["".join(rng.choice("ab é一\U0001F600 tiongth") for _ in range(rng.randint(1, 200)))
                    for _ in range(200)]
    want = [len(e.ids) for e in library(pieces, scores, fallback).encode_batch(texts)]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(-1, None, "k")],
                               "doc_id long, text string, n_tokens string").repartition(3)
    got = {r.doc_id: r.n_tokens for r in token_counts(df, pieces, scores, fallback, ["doc_id"]).collect()}
    assert got.pop(-1) == 0
    assert [got[i] for i in range(len(texts))] == want


def test_ties_keep_the_longest_last_piece(spark):
    # "abc" as a|bc or ab|c or abc at equal scores; sums are exact in doubles
    pieces, scores = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁abc"], [-1.0, -2, -2, -2, -2, -2, -4, -3, -5.0]
    texts = ["abc", "abcabc", "ab c bc", "cab"]
    want = [len(e.ids) for e in library(pieces, scores, False).encode_batch(texts)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(df, pieces, scores, False, ["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert token_counts(df.limit(0), pieces, scores, False, ["doc_id"]).count() == 0


def test_kept_columns_stay_when_others_clash(spark):
    pieces, scores, _ = load_sentencepiece(vocabulary_path())
    df = spark.createDataFrame([(1, "the tea", "a", 2.0, "x"), (1, "the tea", "a", 2.0, "x"), (None, None, None, None, None)],
                               "doc_id long, text string, n_tokens string, score double, odd_name string")
    got = token_counts(df, pieces, scores, True, ["doc_id", "odd_name"])
    assert got.columns == ["doc_id", "odd_name", "n_tokens", "score"]
    rows = got.collect()
    assert rows[0] == rows[1] and rows[0].n_tokens > 0 and rows[0]["odd_name"] == "x" and tuple(rows[2]) == (None, None, 0, 0)
