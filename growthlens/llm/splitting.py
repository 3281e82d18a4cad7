"""Oversized texts cut into pieces at natural boundaries, by bounded-quantifier patterns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlens.llm.encode import Vocabulary, encoder, named

#: Letters that stand for the place after a token, strongest first: paragraph, line, sentence, word; then a place
#: within a word, and one within a character, where nothing may be cut.
PARAGRAPH, LINE, SENTENCE, WORD, INNER, SPLIT_CHAR = "PLSWCX"
#: Characters that end a sentence where a blank or the text's end follows, and those that end it anywhere.
ENDS, ENDS_ANYWHERE = ".!?;:…", "。！？；।؟"
#: Tokens that a character may take beyond its first; a piece may start so much before its overlap.
CHAR_TOKENS = 3
#: Pieces over which sums are run at a time.
STRETCH = 512


def piece_pattern(limit: int, overlap: int) -> str:
    """A pattern whose successive matches in a text's letters are what each piece adds to the one before.

    Alternatives in order: the whole rest; for each kind of place from the strongest, as much as the
    limit allows, but at least half; any natural place; any place between characters. The first
    piece has the whole limit, later ones what their overlap leaves.
    """

    def up_to(most: int) -> str:
        half = max(1, most // 2)
        strong = [f".{{{half - 1},{most - 1}}}{kind}" for kind in (PARAGRAPH, LINE, SENTENCE, WORD)]
        natural = f".{{0,{most - 1}}}[{PARAGRAPH}{LINE}{SENTENCE}{WORD}]"
        return "|".join([f".{{1,{most}}}$", *strong, natural, f".{{0,{most - 1}}}[^{SPLIT_CHAR}]"])

    return f"^(?:{up_to(limit)})|(?:{up_to(limit - overlap - CHAR_TOKENS)})"


def places(text: str, sizes: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The letter of the place after each token; and for place 0 (the start) and those after each token
    the last place up to it that is not within a character, its offset in characters and that in bytes.

    ``sizes`` are the tokens' lengths in bytes.
    """
    raw = np.frombuffer(text.encode(), np.uint8)
    starts = (raw & 0xC0) != 0x80
    ends = np.r_[0, np.cumsum(sizes)]
    within = np.zeros(len(ends), dtype=bool)
    inner = ends < len(raw)
    within[inner] = ~starts[ends[inner]]
    safe = np.maximum.accumulate(np.where(within, 0, np.arange(len(ends))))
    in_bytes = ends[safe]
    at = np.r_[0, np.cumsum(starts)][in_bytes]

    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(points)
    is_in = lambda chars: np.isin(points, [ord(c) for c in chars])
    newline = points == 10
    newline |= (points == 13) & ~np.r_[newline[1:], False]
    blank = is_in("\t\n\v\f\r \x1c\x1d\x1e\x1f\x85\xa0     　") | ((points >= 0x2000) & (points <= 0x200A))
    # for every offset: where the run of blanks that ends there began, and the newlines in it
    lines = np.r_[0, np.cumsum(newline)]
    run_start = np.r_[0, np.maximum.accumulate(np.where(blank, 0, np.arange(1, n + 1)))]
    in_run = lines - lines[run_start]
    before = np.r_[False, blank]
    after = np.r_[blank, True]
    sentence_end = np.r_[False, is_in(ENDS)][run_start] & (before | after)
    sentence_end |= np.r_[False, is_in(ENDS_ANYWHERE)][run_start]
    kind = np.full(n + 1, ord(INNER), np.uint8)
    kind[before | after] = ord(WORD)
    kind[sentence_end] = ord(SENTENCE)
    kind[in_run == 1] = ord(LINE)
    kind[in_run >= 2] = ord(PARAGRAPH)
    letters = kind[at]
    letters[within] = ord(SPLIT_CHAR)
    return letters[1:].tobytes().decode("ascii"), safe, at, in_bytes


def split_oversized(
    df: DataFrame, key: str, text: str, limit: int = 1024, overlap: int = 64, path: str | None = None
) -> DataFrame:
    """Pieces of the texts that have more than ``limit`` tokens of the vocabulary; other texts give no rows.

    Returns key, piece_no (from 1), n_pieces, start_char, end_char (of the piece in the text), n_tokens
    (of the text's own tokens in it), new_tokens (those not in the piece before) and piece (its
    text). Pieces have at most ``limit`` tokens and cover the text without gap. Each begins
    ``overlap`` tokens before the end of the one before; where that is within a character, at that
    character's start. Cuts lie at a paragraph's, line's, sentence's or word's end if the piece's
    second half has one, in this order, else at its last natural place, else between characters.

    Null, empty and short texts, and empty tables, give no rows. Rows with equal keys are cut each by itself.

    Scale: one pass without shuffle. Texts of at most ``limit`` bytes cannot have more tokens and are
    filtered in the scan's stage. Python gives each token's place a letter and cuts the text there; pieces
    and overlaps are a pattern and array functions in the JVM, linear in the text's length.
    """
    if not 0 <= overlap + CHAR_TOKENS < limit:
        raise ValueError("the overlap must be smaller than the limit")
    clash = {"piece_no", "n_pieces", "start_char", "end_char", "n_tokens", "new_tokens", "piece"}
    if key in clash:
        raise ValueError(f"the key must not be called {key}")
    vocabulary = Vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        size_of = np.zeros(max(own.bytes_of) + 1, np.int64)
        for token, b in own.bytes_of.items():
            size_of[token] = len(b)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            for lo in range(0, len(texts), 64):  # few texts' ids at a time
                ids, at = own.encode(texts[lo : lo + 64])
                long = [i for i in range(len(at) - 1) if at[i + 1] - at[i] > limit]
                if long:
                    yield marked_rows(batch.select([key]).take(pa.array([lo + i for i in long])), [(texts[lo + i], *places(texts[lo + i], size_of[ids[at[i] : at[i + 1]]])) for i in long])

    def marked_rows(keys: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        joined = lambda k: np.concatenate([f[k] for f in found]).astype(np.int32)
        ends = np.cumsum([0, *(len(f[2]) for f in found)]).astype(np.int32)
        # the texts' parts between places, without a Python string for each
        raw = [f[0].encode() for f in found]
        bases = np.cumsum([0, *map(len, raw)])
        cuts = np.concatenate([[0], *(f[4][1:] + base for f, base in zip(found, bases))]).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(b"".join(raw)))
        part_ends = (ends - np.arange(len(ends))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(part_ends), parts), *(pa.ListArray.from_arrays(pa.array(ends), pa.array(joined(k))) for k in (2, 3))]
        return pa.RecordBatch.from_arrays([keys.column(0), pa.array([f[1] for f in found]), *lists], names=[key, "__kinds", "__parts", "__safe", "__chars"])

    long = df.select(key, F.col(text).alias("__text")).where(F.octet_length("__text") > limit)
    marked = long.mapInArrow(run, f"{named(df, [key])}, __kinds string, __parts array<string>, __safe array<int>, __chars array<int>")

    added = F.transform(F.regexp_extract_all("__kinds", F.lit(piece_pattern(limit, overlap)), F.lit(0)), F.length)

    def sums_before(items: Column) -> Column:
        """For each item, and the end, the sum of the items before."""
        return F.aggregate(items, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    # appending copies the array, so sums are run over stretches, then over these: no array grows with the text's square
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size("__added") - 1) / STRETCH).cast("int")), lambda k: F.slice("__added", k * STRETCH + 1, STRETCH))
    own_sums = F.transform("__stretches", sums_before)
    bases = sums_before(F.transform("__sums", lambda x: F.element_at(x, -1)))
    ends = F.flatten(F.transform("__sums", lambda x, k: F.transform(F.slice(x, 1, F.size(x) - 1), lambda y: y + F.get("__bases", k))))

    def piece(i: Column) -> Column:
        """The i-th piece of a text: a stretch of its parts."""
        before, new = F.get("__ends", i), F.get("__added", i)
        start = F.get("__safe", F.when(i == 0, F.lit(0)).otherwise(F.greatest(before - overlap, F.lit(0))))
        return F.struct(
            (i + 1).alias("piece_no"),
            F.size("__added").alias("n_pieces"),
            F.get("__chars", start).alias("start_char"),
            F.get("__chars", before + new).alias("end_char"),
            (before + new - start).alias("n_tokens"),
            new.alias("new_tokens"),
            F.array_join(F.slice("__parts", start + 1, before + new - start), "").alias("piece"),
        )

    cut = marked.withColumn("__added", added).withColumn("__stretches", stretches).withColumn("__sums", own_sums).withColumn("__bases", bases).withColumn("__ends", ends)
    pieces = F.transform(F.sequence(F.lit(0), F.size("__added") - 1), piece)
    return cut.select(key, F.explode(pieces).alias("__piece")).select(key, "__piece.*")
