import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from growthlens.llm import encode
from growthlens.llm.encode import PrefixEncoder, count_tokens, encode_texts, tokenizer_path


@pytest.fixture(scope="session")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="session")
def own():
    with open(tokenizer_path(), "rb") as f:
        return PrefixEncoder(f.read())


def ids(own, text):
    flat, offsets = own.encode([text])
    assert list(offsets) == [0, len(flat)] and own.count([text]) == [len(flat)]
    return list(flat)


def test_vocabulary_is_that_of_the_rank_file(own):
    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    assert own.ids == ranks


@settings(max_examples=600, deadline=None)
@given(st.text(max_size=60))
def test_any_text(own, library, text):
    assert ids(own, text) == library(text)


PARTS = ["a", "e", "th", "ing", "s", " ", "  ", "\n", "\r\n", "\t", "'", "'s", "'ll", "1", "23", "é", "😀", "漢字", "—", "--", "==", ".", "...", "<|endoftext|>", "ß", "İ", "\x00", "\x85", "　", "‍"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40))
def test_awkward_texts(own, library, parts):
    text = "".join(parts)
    assert ids(own, text) == library(text)


def test_long_texts(own, library):
    r = random.Random(1)
    for text in ("a" * 50_000, "-" * 50_000, "ab" * 20_000, "".join(r.choice("abcdefgh") for _ in range(50_000)), "word and more, " * 90_000):
        assert ids(own, text) == library(text)


def test_memory_is_bounded_and_slices_do_not_matter(own, library, monkeypatch):
    monkeypatch.setattr(encode, "SLICE", 40)
    monkeypatch.setattr(encode, "MEMORY", 5)
    texts = ["one two three", None, "", "four " * 30, "x", "one two", "\n" * 100, "five six seven eight nine ten eleven"]
    flat, offsets = own.encode(texts)
    assert [list(flat[a:b]) for a, b in zip(offsets, offsets[1:])] == [library(t or "") for t in texts]
    assert own.count(texts) == [len(library(t or "")) for t in texts] and len(own.memory) < 40


def test_frames(spark, library):
    texts = ["Hello, world", None, "", "   ", "Hello, world", "x" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("__text", F.lit("clash")).repartition(3)
    got = {r["id"]: r["ids"] for r in encode_texts(df, ["id"], "text").collect()}
    assert got == {i: library(t or "") for i, t in enumerate(texts)}
    assert {r["id"]: r["n_tokens"] for r in count_tokens(df, ["id"], "text").collect()} == {i: len(v) for i, v in got.items()}
    assert encode_texts(df.limit(0), ["id"], "text").count() == 0
    with pytest.raises(ValueError):
        encode_texts(df.withColumn("ids", F.lit(1)), ["ids"], "text")
