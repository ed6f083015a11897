import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer, models, normalizers

from tributary.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


def exact(vocab, texts, byte_fallback=True):
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=byte_fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return [len(e.ids) if x else 0 for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True)]


def test_vocabulary_is_the_models():
    import sentencepiece

    of = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert tokens.read_vocabulary(PATH) == [(of.id_to_piece(i), pytest.approx(of.get_score(i))) for i in range(of.get_piece_size())]


def test_edge_cases():
    texts = ["", " ", "   ", "a", " a  b ", "x" * 300, "\n\n\t", "▁▁x▁", "<s> <unk> <0x41>", "日本語 テキスト", "👩‍👩‍👧 é́ \x00\x85 ", "straße ẞ \U0001e4d0\U0001e4d1 z", "a b"]
    assert [tokens.counter(PATH).count(t) for t in texts] == exact(tokens.unigram(PATH), texts)


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_ties_and_unknowns_as_in_the_tokenizer(byte_fallback):
    rnd = random.Random(9)
    for _ in range(40):
        pieces = {"".join(rnd.choice("abc▁") for _ in range(rnd.randint(1, 4))) for _ in range(12)}
        vocab = [("<unk>", -9.0), *((p, float(-rnd.randint(1, 4))) for p in sorted(pieces))]
        texts = ["".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, 25))) for _ in range(40)]
        of = tokens.Counter(vocab, byte_fallback)
        assert [of.count(t) for t in texts] == exact(vocab, texts, byte_fallback), vocab


def test_sf(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: r.n_tokens for r in tokens.op9_tokens(spark, "/root/testdata/sf0.01").collect()}
    assert [got[i] for i in text] == exact(tokens.unigram(PATH), list(text.values()))


def test_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, None, 0), (None, "a b", 0), (2, "", 0), (2, "", 0)], "doc_id long, text string, n_tokens int")
    got = sorted((str(r.id), r.n_chars, r.n_tokens) for r in tokens.count_tokens(df, PATH).collect())
    assert got == [("1", 0, 0), ("2", 0, 0), ("2", 0, 0), ("None", 3, 2)]
    assert tokens.count_tokens(df.limit(0), PATH).collect() == []


def test_memory_of_words_is_bounded(monkeypatch):
    of = tokens.Counter(tokens.unigram(PATH))
    want = [of.count(f"word{i} other{i}") for i in range(50)]
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    of = tokens.Counter(tokens.unigram(PATH))
    assert [of.count(f"word{i} other{i}") for i in range(50)] == want and len(of.seen) == 3


def test_scores_are_log_probabilities():
    vocab = tokens.unigram(PATH)
    scores = dict(vocab)
    assert [p for p, _ in vocab] == [p for p, _ in tokens.read_vocabulary(PATH)]
    assert np.isclose(np.exp([s for _, s in vocab]).sum(), 1)
    assert scores["▁t"] > scores["in"] > scores["ゼ"] > scores["</s>"]
    assert tokens.log_probabilities([("<s>", 0.0), ("a", -1.0), ("b", -7.0)], 1) == [("<s>", pytest.approx(np.log(3 / 13))), ("a", pytest.approx(np.log(6 / 13))), ("b", pytest.approx(np.log(4 / 13)))]


def test_counts_are_near_the_merge_tokenizers():
    """The same pieces under merges give about as many tokens."""
    import sentencepiece

    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t]
    of = sentencepiece.SentencePieceProcessor(model_file=PATH)
    merged, counted = (sum(x) for x in ([len(i) for i in of.encode(texts)], [tokens.counter(PATH).count(t) for t in texts]))
    assert abs(counted - merged) < 0.02 * merged
