import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from growthlens.llm import splitting
from growthlens.llm.encode import tokenizer_path
from growthlens.llm.splitting import split_oversized


@pytest.fixture(scope="session")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def texts():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randrange(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(r.randrange(3, 15))).capitalize() + "."
    paragraph = lambda: " ".join(sentence() for _ in range(r.randrange(1, 3)))
    return [
        "\n\n".join(paragraph() for _ in range(40)), "\r\n\r\n".join(paragraph() for _ in range(20)), "\n".join(sentence() for _ in range(80)), " ".join(sentence() for _ in range(80)),
        " ".join(word() for _ in range(600)), "".join(word() for _ in range(500)), "漢字かな。" * 300, "😀" * 400, "é" * 900, "-" * 30_000, " " * 3_000, "\n" * 3_000, "x" * 100 + " " + "😀" * 500,
        "short", "", None, "   ",
    ]


@pytest.mark.parametrize("limit,overlap", [(100, 10), (64, 0), (1024, 64)])
def test_pieces(spark, library, limit, overlap):
    data = dict(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "clash") for i, t in data.items()], "id int, text string, piece string")
    got = {}
    for r in split_oversized(df, "id", "text", limit, overlap).collect():
        got.setdefault(r["id"], []).append(r)
    sizes = {i: len(library(t or "")) for i, t in data.items()}
    assert set(got) == {i for i, n in sizes.items() if n > limit}
    for i, pieces in got.items():
        text = data[i]
        pieces.sort(key=lambda r: r["piece_no"])
        assert [r["piece_no"] for r in pieces] == list(range(1, len(pieces) + 1)) and {r["n_pieces"] for r in pieces} == {len(pieces)} and len(pieces) > 1
        assert pieces[0]["start_char"] == 0 and pieces[-1]["end_char"] == len(text)
        assert sum(r["new_tokens"] for r in pieces) == sizes[i]
        for r in pieces:
            assert r["piece"] == text[r["start_char"] : r["end_char"]] and r["n_tokens"] <= limit and len(library(r["piece"])) <= limit
        for before, r in zip(pieces, pieces[1:]):
            assert overlap <= r["n_tokens"] - r["new_tokens"] <= overlap + 3 and r["start_char"] <= before["end_char"]
            if overlap:
                assert r["start_char"] < before["end_char"]


def test_cuts_are_natural(spark):
    data = dict(enumerate(texts()))
    df = spark.createDataFrame(list(data.items()), "id int, text string")
    ends = {}
    for r in split_oversized(df, "id", "text", 200, 20).collect():
        if r["piece_no"] < r["n_pieces"]:
            ends.setdefault(r["id"], []).append(data[r["id"]][: r["end_char"]])
    assert all(t.endswith("\n\n") for t in ends[0]) and all(t.endswith("\r\n\r\n") for t in ends[1])
    assert all(t.endswith("\n") for t in ends[2]) and all(t.rstrip().endswith(".") for t in ends[3])
    assert all(data[4][len(t)] == " " or t.endswith(" ") for t in ends[4]) and all(t.endswith("。") for t in ends[6])


def test_stretches_do_not_matter(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(texts())), "id int, text string")
    of = lambda: sorted(tuple(r) for r in split_oversized(df, "id", "text", 40, 5).select("id", "piece_no", "start_char", "end_char", "n_tokens").collect())
    one = of()
    for stretch in (1, 3):
        monkeypatch.setattr(splitting, "STRETCH", stretch)
        assert of() == one


def test_empty_repeated_refused(spark):
    df = spark.createDataFrame([(1, "word " * 300)] * 2 + [(None, "word " * 300)], "id int, text string")
    assert split_oversized(df, "id", "text", 200, 20).count() == 3 * split_oversized(df.where("id is null"), "id", "text", 200, 20).count()
    assert split_oversized(df.limit(0), "id", "text").count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "id", "text", 64, 64)
    with pytest.raises(ValueError):
        split_oversized(df.withColumn("piece", F.lit(1)), "piece", "text")
