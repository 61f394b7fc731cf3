import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rookery.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "B", "é", "É", "ß", "İ", "Σ", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "'s", "'", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "1", "!", "?.", ",", ". ", ", ", ".\n", "J", "̌", "h", "̱", "é", "中", "ё", "🙂", "ﬁ", "the", "2. ", "œ", "-", "\x0b", "µ", "×"]


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_ids_are_the_tokenizers():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    plain = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [ids(x) for x in tokens.encoded([t.encode() for t in texts], PATH)] == plain


def test_long_texts_are_cut_where_no_id_changes(monkeypatch):
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choice(PIECES) for _ in range(9)) for _ in range(3000))
    monkeypatch.setattr(tokens, "RUN_BYTES", 500)
    monkeypatch.setattr(tokens, "WORDS_KEPT", 300)
    assert len(tokens.parts(text.encode(), 500)) > 20 and b"".join(tokens.parts(text.encode(), 500)) == text.encode()
    assert ids(next(tokens.encoded([text.encode()], PATH))) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_get_whole_texts(name):
    texts = ["two  words\n", "", "naïve <|endoftext|> café"]
    path = public_tokenizers.path(name)
    if name.endswith("json"):
        plain = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    else:
        import sentencepiece

        plain = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    assert [ids(x) for x in tokens.encoded([t.encode() for t in texts], path)] == plain


def test_rows(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "y"), (None, "", None), (3, None, "z"), (4, "word " * 3000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(tokens.count_tokens(df, PATH).collect(), key=str)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == [(0, 0, 0, False), (1, 11, 2, False), (1, 11, 2, False), (3, 0, 0, False), (4, 15000, 3000, True)]
    assert tokens.count_tokens(df.limit(0), PATH).count() == 0
