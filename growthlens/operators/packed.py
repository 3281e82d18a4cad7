"""Several values packed in one field: dictionary-guided segmentation."""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.session import ship, stored

#: A bare value's characters, and a text in quotes, where a doubled double quote stands for one (fixed forms).
BARE_CHARS = r"\p{L}\p{N}+#._\-"
BARE = rf"[{BARE_CHARS}]+"
QUOTED = r"\"(?:[^\"]|\"\")*\"|'[^']*'"

#: Texts in quotes that stand by themselves: no bare character or quote touches them from outside. For the JVM, where
#: only possessive loops need no stack for long texts.
CLEAN = rf"""(?<![{BARE_CHARS}"'])(?:"(?:[^"]++|"")*+"|'[^']*+')(?![{BARE_CHARS}"'])"""
#: Characters of a dictionary that are shipped at once.
DICTIONARY_CHARS = 4_000_000


def unquote(form: str) -> str:
    """The value of a written form: outer quotes and blanks dropped, doubled double quotes single."""
    if len(form) > 1 and form[0] == form[-1] == '"':
        form = form[1:-1].replace('""', '"')
    elif len(form) > 1 and form[0] == form[-1] == "'":
        form = form[1:-1]
    return form.strip()


class Segmenter:
    """Cuts a field into values by the cheapest cover of its characters.

    Pieces of a cover are runs of bare characters, texts in quotes, and single separators; with
    ``protect_bare`` known values that hold separators are pieces without quotes too. A quote may
    open a text or, like one without partner, stand as a separator, so where quotes are stray or
    missing covers compete. The dictionary of known quoted forms decides between them. Costs, in
    this order: the characters of known values, found by the automaton, that the cover cuts apart; quotes that
    could open a text but stand as separators; the number of pieces. Without a known value at
    stake this is the reading from left to right, in which every quote with a partner opens a text.
    """

    def __init__(self, forms: Iterable[str], protect_bare: bool = False) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.protect_bare = protect_bare
        self.bare, self.quoted, self.char = regex.compile(BARE), regex.compile(QUOTED), regex.compile(f"[{BARE_CHARS}]")
        for form in forms:
            self.automaton.add_word(form, len(form))
            value = unquote(form)
            if protect_bare and value and not self.bare.fullmatch(value) and value[0] not in "\"'":
                self.automaton.add_word(value, len(value))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def known(self, text: str) -> list[tuple[int, int]]:
        """Start and end of the known values in a text: quoted ones that stand by themselves, others between whole runs."""
        if not self.any:
            return []
        found, is_bare = [], self.char.match
        for last, size in self.automaton.iter(text):
            s, e = last + 1 - size, last + 1
            before, after = text[s - 1 : s] if s else "", text[e : e + 1]
            if text[s] in "\"'":
                whole = not (before and (before in "\"'" or is_bare(before)) or after and (after in "\"'" or is_bare(after)))
            else:
                whole = not (before and is_bare(before) and is_bare(text[s]) or after and is_bare(after) and is_bare(text[e - 1]))
            if whole:
                found.append((s, e))
        return found

    def __call__(self, text: str | None, known: list[tuple[int, int]] | None = None) -> list[str]:
        """The values in order; ``known`` may come from several dictionaries. Null, empty and separator-only fields have none."""
        if not text:
            return []
        known = sorted(self.known(text) if known is None else known)
        runs = {m.start(): m.end() for m in self.bare.finditer(text)}
        quoted = {i: m.end() for i, c in enumerate(text) if c in "\"'" and (m := self.quoted.match(text, i))}
        starts = [s for s, _ in known]
        loose: dict[int, list[int]] = {}
        for s, e in known:
            if text[s] not in "\"'":
                loose.setdefault(s, []).append(e)

        def cut_apart(s: int, e: int) -> int:
            """Characters of the known values that begin in a piece and go beyond it."""
            return sum(b - a for a, b in known[bisect_left(starts, s) : bisect_left(starts, e)] if b > e) if known else 0

        # per position: cost to the end (characters cut apart, quotes passed over, pieces), the next position, whether a value
        n = len(text)
        best: list[tuple[int, int, int, int, bool]] = [(0, 0, 0, n, False)] * (n + 1)
        for i in range(n - 1, -1, -1):
            ends = [(e, 0, True) for e in loose.get(i, ())]
            if i in quoted:
                ends += [(quoted[i], 0, True), (i + 1, 1, False)]
            else:
                ends.append((runs[i], 0, True) if i in runs else (i + 1, 0, False))
            best[i] = min((best[e][0] + cut_apart(i, e), best[e][1] + passed, best[e][2] + taken, e, taken) for e, passed, taken in ends)
        values, i = [], 0
        while i < n:
            _, _, _, e, taken = best[i]
            if taken and (value := unquote(text[i:e])):
                values.append(value)
            i = e
        return values


def known_forms(df: DataFrame, column: str) -> DataFrame:
    """The dictionary: distinct quoted forms (column form) that stand by themselves and whose value holds a separator.

    Others cannot change a cover. As a frame, for the dictionary grows with the data.
    """
    form = F.explode(F.regexp_extract_all(F.col(column), F.lit(CLEAN), F.lit(0))).alias("form")
    return df.select(form).where(~F.regexp_like(F.substring("form", F.lit(2), F.length("form") - 2), F.lit(rf"^\s*[{BARE_CHARS}]*\s*$"))).distinct()


_ready: dict[tuple[str, bool], Segmenter] = {}


def segmenter(name: str, shipped, protect_bare: bool) -> Segmenter:
    """The worker's segmenter of a broadcast dictionary, built once per worker process."""
    if (name, protect_bare) not in _ready:
        _ready.clear()
        _ready[name, protect_bare] = Segmenter(shipped.value, protect_bare)
    return _ready[name, protect_bare]


def split_packed(df: DataFrame, keep: list[str], column: str, forms: DataFrame | None = None, protect_bare: bool = False, at_once: int = DICTIONARY_CHARS) -> DataFrame:
    """One row per value of ``column``: the ``keep`` columns, pos (from 1) and value.

    A value is a run of letters, digits and ``+ # . _ -``, or a text in single or double quotes, in
    which everything belongs to the value and a doubled double quote stands for one; outer blanks
    are dropped and blank values do not count. Anything else, also a quote without partner,
    separates. Case and repeats are kept. Null and empty fields give no row, as does an empty table.

    ``forms`` is the dictionary (see ``known_forms``). Where quotes are stray or missing, so that texts in
    quotes could be read in several ways, the way that keeps known values whole is taken; without dictionary
    that from left to right. With ``protect_bare`` known values are whole without quotes too.
    ``keep`` columns must not be called pos, value or __hits.

    Scale: one pass without shuffle. The dictionary is shipped in parts of about ``at_once`` characters. Is
    there more than one, a pass per part collects the places of known values, stored in between, and the cover
    is found from all of them: the same rows, with one part in a worker's memory at a time.
    """
    if clash := {"pos", "value", "__hits"} & set(keep):
        raise ValueError(f"columns to keep must be renamed: {sorted(clash)}")
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    source = df.select(*keep, F.col(column).cast("string").alias("__packed")).where(F.col("__packed").isNotNull())
    context = ship(df.sparkSession).sparkContext

    parts = 1
    if forms is not None:
        forms = stored(forms)
        parts = 1 + (forms.agg(F.sum(F.length("form"))).first()[0] or 0) // at_once

    def part(k: int) -> tuple:
        own = forms if parts == 1 or forms is None else forms.where(F.pmod(F.xxhash64("form"), F.lit(parts)) == k)
        return uuid.uuid4().hex, context.broadcast([r["form"] for r in own.collect()] if own is not None else [])

    def rows_of(batch: pa.RecordBatch, found: list[list[str]]) -> pa.RecordBatch:
        at = [i for i, values in enumerate(found) for _ in values]
        kept = batch.select(keep).take(pa.array(at, pa.int64())).columns if keep else []
        pos = pa.array([p for values in found for p in range(1, len(values) + 1)], pa.int32())
        return pa.RecordBatch.from_arrays([*kept, pos, pa.array([v for values in found for v in values], pa.string())], names=[*keep, "pos", "value"])

    name, shipped = part(0)
    head = fields + (", " if fields else "")
    if parts == 1:

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            segment = segmenter(name, shipped, protect_bare)
            for batch in batches:
                yield rows_of(batch, [segment(t) for t in batch.column("__packed").to_pylist()])

        return source.mapInArrow(cut, f"{head}pos int, value string")

    def finder(name: str, shipped):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = segmenter(name, shipped, protect_bare)
            for batch in batches:
                hits = [[*old, *(x for hit in own.known(t) for x in hit)] for t, old in zip(batch.column("__packed").to_pylist(), batch.column("__hits").to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.select([*keep, "__packed"]).columns, pa.array(hits, pa.list_(pa.int32()))], names=[*keep, "__packed", "__hits"])

        return find

    marked = source.withColumn("__hits", F.array().cast("array<int>"))
    for k in range(parts):
        name, shipped = (name, shipped) if k == 0 else part(k)
        marked = stored(marked.mapInArrow(finder(name, shipped), f"{head}__packed string, __hits array<int>"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segmenter([], protect_bare)
        for batch in batches:
            pairs = [list(zip(h[::2], h[1::2])) for h in batch.column("__hits").to_pylist()]
            yield rows_of(batch, [segment(t, known) for t, known in zip(batch.column("__packed").to_pylist(), pairs)])

    return marked.mapInArrow(cover, f"{head}pos int, value string")
