"""Token ids of a whole corpus, by a prefix-sharing traversal of its words."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.session import ship

#: How byte-level vocabularies of this family cut text into words before merging (fixed pattern; the commonest
#: alternative comes first, as no text fits both it and a later one), and the same for texts in ASCII.
WORDS = r""" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_WORDS = r""" ?[A-Za-z]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: Characters of text whose words are held at a time, and words whose ids are remembered.
SLICE, MEMORY = 1_000_000, 400_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where an installed public vocabulary lies; any other path may be given to the operators instead."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def byte_of_char() -> dict[str, int]:
    """The bytes that the vocabulary file's printable characters stand for.

    Bytes that print in Latin-1 stand for themselves; the others follow from code point 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """Byte-pair encoding of words, with the work on shared prefixes done once.

    For every prefix of a word the last token of the prefix's own encoding is kept. It determines
    the rest: what precedes it is the encoding of the shorter prefix. A token can end a prefix if the
    last token of the shorter prefix and it stay apart when their bytes are encoded together. Words
    are visited in byte order, which is the depth-first order of their trie, so the states of the
    path to a common ancestor are those of the word before.
    """

    def __init__(self, file: bytes) -> None:
        model = json.loads(file)["model"]
        chars = byte_of_char()
        raw = {name: bytes(map(chars.__getitem__, name)) for name in model["vocab"] if all(c in chars for c in name)}
        self.pattern, self.ascii = regex.compile(WORDS), re.compile(ASCII_WORDS, re.ASCII)
        self.ids: dict[bytes, int] = {}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        vocab = model["vocab"]
        for order, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.merged[a, b] = (order, whole)
            self.halves.setdefault(whole, (a, b))
            self.rank.setdefault(whole, order)
        reachable = [(vocab[name], b) for name, b in raw.items() if len(b) == 1 or vocab[name] in self.halves]
        self.apart: dict[int, bool] = {}
        self.ids = {b: i for i, b in reachable if self.whole(i)}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.tails = {b[i:] for b in self.ids for i in range(len(b))}
        self.memory: dict[str, bytes] = {}  # a word's ids as 32-bit integers

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that touch one side of a token while it is merged, each with the step that ends it."""
        steps: list[tuple[int, float]] = [(token, float("inf"))]
        while token in self.halves:
            ends = self.rank[token]
            token = self.halves[token][side]
            steps.append((token, ends))
        return steps

    def merge_across(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Whether any merge joins tokens over the border of two neighbours before they are finished.

        A merge is done at its step; of two at the same step the one further left comes first.
        """
        merged = self.merged
        for a, a_ends in self.spine(left, 1):
            for b, b_ends in self.spine(right, 0):
                step = merged.get((a, b))
                if step is not None and step[0] < min(a_ends, before) and step[0] <= b_ends:
                    return True
        return False

    def whole(self, token: int) -> bool:
        """Whether the encoding of a token's bytes is that token."""
        if token not in self.halves:
            return True
        left, right = self.halves[token]
        return not self.merge_across(left, right, self.rank[token])

    def stay_apart(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) > 4 * MEMORY:
                self.apart.clear()
            found = self.apart[key] = not self.merge_across(left, right)
        return found

    def learn(self, words: list[str]) -> None:
        """Encode new words along their trie and remember them."""
        ids, tails, stay_apart = self.ids, self.tails, self.stay_apart
        before = b""
        last: list[int] = [0]  # last[d]: last token of the first d bytes
        size: list[int] = [0]  # and its length
        for raw, word in sorted((w.encode(), w) for w in words):
            shared = 0
            for x, y in zip(before, raw):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                start = end - 1
                while start >= 0 and (piece := raw[start:end]) in tails:
                    token = ids.get(piece)
                    if token is not None and (start == 0 or stay_apart(last[start], token)):
                        break
                    start -= 1
                else:
                    raise ValueError(f"no token of the vocabulary ends {raw[:end]!r}")
                last.append(token)
                size.append(end - start)
            out, at = [], len(raw)
            while at:
                out.append(last[at])
                at -= size[at]
            out.reverse()
            self.memory[word] = array("i", out).tobytes()
            before = raw

    def slices(self, texts: list[str | None]) -> Iterator[list[tuple[list[str], bool]]]:
        """The texts' words, some at a time, after all of these have been learnt.

        The flag says whether a text ends with these words; a long text comes in several parts.
        """
        held: list[tuple[list[str], bool]] = []
        volume = 0
        for text in texts:
            pattern = self.ascii if text and text.isascii() else self.pattern
            if text and len(text) > SLICE:
                for part in batched((m.group() for m in pattern.finditer(text)), SLICE // 4):
                    held.append((list(part), False))
                    yield self.known(held)
                    held, volume = [], 0
                held.append(([], True))
                continue
            held.append((pattern.findall(text) if text else [], True))
            volume += len(text) if text else 0
            if volume > SLICE:
                yield self.known(held)
                held, volume = [], 0
        if held:
            yield self.known(held)

    def known(self, held: list[tuple[list[str], bool]]) -> list[tuple[list[str], bool]]:
        if len(self.memory) > MEMORY:
            self.memory.clear()
        new: set[str] = set()
        for words, _ in held:
            new.update(words)
        self.learn([w for w in new if w not in self.memory])
        return held

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the offsets at which each text's ids begin and end."""
        parts, ends, so_far = [], [0], 0
        for held in self.slices(texts):
            get = self.memory.__getitem__
            for words, done in held:
                part = b"".join(map(get, words))
                parts.append(part)
                so_far += len(part)
                if done:
                    ends.append(so_far)
        return np.frombuffer(b"".join(parts), np.int32), (np.array(ends, np.int64) // 4).astype(np.int32)

    def count(self, texts: list[str | None]) -> list[int]:
        """The number of ids of each text."""
        out, so_far = [], 0
        for held in self.slices(texts):
            get = self.memory.__getitem__
            for words, done in held:
                so_far += sum(map(len, map(get, words)))
                if done:
                    out.append(so_far // 4)
                    so_far = 0
        return out


_ready: dict[int, PrefixEncoder] = {}


def encoder(shipped) -> PrefixEncoder:
    """The worker's encoder of a broadcast vocabulary file, built once per worker process."""
    if shipped.id not in _ready:
        _ready.clear()
        _ready[shipped.id] = PrefixEncoder(shipped.value)
    return _ready[shipped.id]


class Vocabulary:
    """A vocabulary file's bytes, broadcast. The file is a few MB; over ``most_mb`` is refused."""

    def __init__(self, df: DataFrame, path: str | None, most_mb: int = 64) -> None:
        with open(path or tokenizer_path(), "rb") as f:
            data = f.read()
        if len(data) > most_mb << 20:
            raise ValueError(f"the vocabulary file has over {most_mb} MB")
        self.id = hash(data)
        self._data = ship(df.sparkSession).sparkContext.broadcast(data)

    @property
    def value(self) -> bytes:
        return self._data.value


def named(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def encode_texts(df: DataFrame, keep: list[str], text: str, path: str | None = None, out: str = "ids") -> DataFrame:
    """The ``keep`` columns and the token ids of ``text`` (array of int), one row per row.

    No special tokens are added and their strings are ordinary text. Null and empty texts have an
    empty array. Texts of any length are encoded whole. An empty table gives no rows.

    Scale: one pass without shuffle. Each worker encodes a distinct word of its input about once and
    remembers MEMORY words; texts pass through in slices of SLICE characters' words.
    """
    if out in keep:
        raise ValueError(f"{out} is among the columns to keep")
    vocabulary = Vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            ids, offsets = own.encode(batch.column("__text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, lists], names=[*keep, out])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{named(df, keep)}, `{out}` array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str, path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """As ``encode_texts``, but with the number of ids (0 for null and empty texts)."""
    if out in keep:
        raise ValueError(f"{out} is among the columns to keep")
    vocabulary = Vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            counts = pa.array(own.count(batch.column("__text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, counts], names=[*keep, out])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{named(df, keep)}, `{out}` bigint")
