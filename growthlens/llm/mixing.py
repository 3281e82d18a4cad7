"""Sources mixed to target shares, by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from growthlens.functions.values import strip
from growthlens.llm.encode import count_tokens
from growthlens.session import stored

#: Sources that a mixture may have: its targets are held on the driver.
MOST_SOURCES = 10_000
#: Documents for which there is a shard; shards and blocks of a source, least and most.
SHARD_DOCS = 65_536
SHARDS, BLOCKS = (16, 65_536), (1_024, 65_536)
#: Shards that a task deals at least.
SHARDS_A_TASK = 256


def plain_source(name: Column) -> Column:
    """Source names are compared trimmed, in lower case and with _ for -."""
    return F.translate(F.lower(strip(name)), "-", "_")


@dataclass
class Target:
    source: str
    share: float
    repeats: int


def grain(docs: DataFrame, sources: int, blocks: int | None, shards: int | None) -> tuple[int, int]:
    """Blocks per source and shards: those given, else by the number of documents, which no file layout changes.

    Blocks are some times as many as shards, so that a shard gets a fair number of them. Both are
    bounded, and with them what the task holds that draws from a source.
    """
    shards = shards or min(max(docs.count() // SHARD_DOCS, SHARDS[0]), SHARDS[1])
    return blocks or min(max(16 * shards // max(sources, 1), BLOCKS[0]), BLOCKS[1]), shards


def read_targets(targets: DataFrame) -> list[Target]:
    """The targets, from columns source, target_share and max_repeats, sorted by source.

    Rows without source or share are left out; a missing max_repeats is 1. Two rows of one source,
    or more than MOST_SOURCES, are refused.
    """
    rows = targets.select(plain_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share is not null").limit(MOST_SOURCES + 1).collect()
    found = sorted((Target(r["source"], float(r["target_share"]), 1 if r["max_repeats"] is None else int(r["max_repeats"])) for r in rows), key=lambda t: t.source)
    if len(found) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    if len({t.source for t in found}) < len(found):
        raise ValueError("a source has two targets")
    return found


def sized(docs: DataFrame, key: str, text: str, targets: list[Target], blocks: int, seed: int, path: str | None = None) -> DataFrame:
    """key, source, block and n_tokens of the documents whose source has a target.

    A block is one of ``blocks`` random parts of its source.
    """
    own = docs.select(F.col(key).alias("key"), plain_source(F.col("source")).alias("source"), F.col(text).alias("text"))
    own = own.where(F.col("source").isin([t.source for t in targets]))
    block = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(blocks)).cast("int")
    return count_tokens(own, ["key", "source"], "text", path).withColumn("block", block)


def dealt(quotas: np.ndarray, shards: int, seed: int, first: int = 0, last: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of the shards from ``first`` to before ``last``: number, and the first and the number of each source's drawn blocks in it.

    A node of the tree deals its exact quotas out to its two halves: the left half's blocks are a draw
    without replacement from all blocks of the node, which is multivariate hypergeometric. Every node
    has a generator of its own, so any part of the tree comes from the root by itself: only the
    nodes above and among the wanted shards are visited.
    """
    last = shards if last is None else last
    open_nodes = [(0, shards, np.zeros(len(quotas), np.int64), quotas.astype(np.int64))]
    while open_nodes:
        lo, hi, start, q = open_nodes.pop()
        if hi <= first or lo >= last:
            continue
        if hi - lo == 1:
            yield lo, start, q
            continue
        mid = (lo + hi) // 2
        share = int(round(int(q.sum()) * (mid - lo) / (hi - lo)))
        left = np.random.default_rng((seed, lo, hi)).multivariate_hypergeometric(q, share, method="marginals")
        open_nodes += [(mid, hi, start + left, q - left), (lo, mid, start, left)]


@dataclass
class Quota:
    """What a source contributes: whole copies, and ``rest`` tokens of one more (None if no copy more may be used)."""

    index: int
    tokens: int
    wanted: float
    copies: int
    rest: float | None


def quotas(totals: dict[str, int], targets: list[Target]) -> dict[str, Quota]:
    """The total is the tokens of all sources with a target; a quota is the target share of it, at most the source's tokens times its max_repeats."""
    total = sum(totals.get(t.source, 0) for t in targets)
    found = {}
    for k, t in enumerate(targets):
        tokens, wanted = totals.get(t.source, 0), t.share * total
        quota = min(wanted, tokens * t.repeats)
        copies = min(int(quota // tokens), t.repeats) if tokens else 0
        found[t.source] = Quota(k, tokens, wanted, copies, quota - copies * tokens if tokens and copies < t.repeats else None)
    return found


def choice(tokens: np.ndarray, plan: Quota, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number of a copy and the blocks drawn in it, in random order: whole copies, then of one more each block that still fits."""
    rng = np.random.default_rng((seed, plan.index))
    for copy in range(plan.copies):
        yield copy, rng.permutation(len(tokens))
    if plan.rest is not None:
        rest, fitting = plan.rest, []
        for i in rng.permutation(len(tokens)):  # a block that no longer fits is passed over for later ones
            if tokens[i] <= rest:
                fitting.append(i)
                rest -= tokens[i]
        yield plan.copies, np.array(fitting, np.int64)


def blocks_of(parts: Iterator[pa.RecordBatch]) -> tuple[str, np.ndarray, np.ndarray]:
    """A source with its blocks and their tokens, in the blocks' order."""
    table = pa.Table.from_batches(list(parts)).sort_by("block")
    return table.column("source")[0].as_py(), table.column("block").to_numpy(), table.column("tokens").to_numpy()


def drawn_blocks(sums: DataFrame, planned: dict[str, Quota], seed: int) -> DataFrame:
    """The blocks drawn from each source: source, k (the source's number), block, copy and p (from 0, the source's random order).

    ``sums`` has source, block and tokens. A source is one task, which holds its blocks' sums.
    """

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, blocks, tokens = blocks_of(parts)
        p = 0
        for copy, at in choice(tokens, planned[source], seed):
            n = len(at)
            own = [pa.array([source] * n, pa.string()), *(pa.array(np.full(n, v, np.int32)) for v in (planned[source].index, copy))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(blocks[at].astype(np.int32)), pa.array(p + np.arange(n))], names=["source", "k", "copy", "block", "p"])
            p += n

    return sums.groupBy("source").applyInArrow(draw, "source string, k int, copy int, block int, p bigint")


def drawn_sums(sums: DataFrame, planned: dict[str, Quota], seed: int) -> dict[str, tuple[int, int | None]]:
    """By source, the tokens drawn, and those of the smallest block that the last copy left out."""

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, _, tokens = blocks_of(parts)
        drawn, left = 0, tokens[:0]
        for copy, at in choice(tokens, planned[source], seed):
            drawn += int(tokens[at].sum())
            left = np.delete(tokens, at)
        yield pa.RecordBatch.from_arrays([pa.array([source]), pa.array([drawn], pa.int64()), pa.array([int(left.min()) if len(left) else None], pa.int64())], names=["source", "drawn", "smallest_left"])

    return {r[0]: (r[1], r[2]) for r in sums.groupBy("source").applyInArrow(add, "source string, drawn bigint, smallest_left bigint").collect()}


def dealt_places(spark: SparkSession, counts: np.ndarray, shards: int, seed: int) -> DataFrame:
    """k, p and shard of every drawn block: each task walks the tree to its own shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for shard, start, n in dealt(counts, shards, seed, int(ids[0]), int(ids[-1]) + 1):
                own = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard, np.int32)), pa.array(own.astype(np.int32)), pa.array(start[own]), pa.array(n[own])], names=["shard", "k", "start", "n"])

    ranges = spark.range(0, shards, 1, max(1, shards // SHARDS_A_TASK)).mapInArrow(run, "shard int, k int, start bigint, n bigint")
    return ranges.select("shard", "k", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("p"))


REPORT = "source string, target_share double, max_repeats int, tokens bigint, wanted_tokens double, drawn_tokens bigint, smallest_left bigint, reached_share double, repeats double, short boolean"


def per_source(df: DataFrame, *aggregates: Column) -> dict[str, tuple]:
    """Aggregates by source: a row for each source with a target."""
    return {r[0]: tuple(r)[1:] for r in df.groupBy("source").agg(*aggregates).collect()}


def block_sums(sizes: DataFrame) -> DataFrame:
    """Tokens by source and block, stored: they are summed, then drawn from."""
    return stored(sizes.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")))


def planned_quotas(sums: DataFrame, targets: list[Target]) -> dict[str, Quota]:
    return quotas({s: n for s, (n,) in per_source(sums, F.sum("tokens")).items()}, targets)


def mix_report(docs: DataFrame, targets: DataFrame, key: str, text: str, blocks: int | None = None, shards: int | None = None, seed: int = 0, path: str | None = None) -> DataFrame:
    """One row per target source: its tokens, what was wanted and drawn, the smallest block left out by the last copy, the share reached, whether it is short."""
    wanted = read_targets(targets)
    blocks, shards = grain(docs, len(wanted), blocks, shards)
    sums = block_sums(sized(docs, key, text, wanted, blocks, seed, path))
    planned = planned_quotas(sums, wanted)
    drawn = drawn_sums(sums, planned, seed)
    total, rows = sum(n for n, _ in drawn.values()), []
    for t in wanted:
        q, (own, left) = planned[t.source], drawn.get(t.source, (0, None))
        rows.append((t.source, t.share, t.repeats, q.tokens, float(q.wanted), own, left, own / total if total else 0.0, own / q.tokens if q.tokens else 0.0, q.tokens * t.repeats < q.wanted))
    return docs.sparkSession.createDataFrame(rows, REPORT)


def mix_sources(docs: DataFrame, targets: DataFrame, key: str, text: str, blocks: int | None = None, shards: int | None = None, seed: int = 0, path: str | None = None) -> DataFrame:
    """The mixture: a row for each time a document is drawn.

    Returns the key (under its name), source, copy (from 0), shard, pos (from 1, the random order in
    the shard) and n_tokens. No document is drawn more than max_repeats times; documents of other
    sources and of no source are not drawn. Where the supply allows, a source's tokens fall short of
    its quota by less than its smallest block that is not drawn. Equal seeds give equal mixtures. Without documents or
    targets there are no rows. Null and empty texts have no tokens, yet are drawn with their block.

    Scale: texts are encoded once; their sizes are stored for the second use. The driver holds one row per
    source. Blocks are drawn by source and dealt by shard in tasks of their own, from the seeds of
    the tree's nodes. A source with a third of all rows is spread over its blocks. Each shard is ordered by itself.
    """
    spark = docs.sparkSession
    wanted = read_targets(targets)
    blocks, shards = grain(docs, len(wanted), blocks, shards)
    sizes = stored(sized(docs, key, text, wanted, blocks, seed, path))
    sums = block_sums(sizes)
    draws = stored(drawn_blocks(sums, planned_quotas(sums, wanted), seed))
    drawn = per_source(draws, F.count("*"))
    counts = np.array([drawn.get(t.source, (0,))[0] for t in wanted], np.int64)
    placed = draws.join(dealt_places(spark, counts, shards, seed), ["k", "p"]).select("source", "block", "copy", "shard")
    place = W.partitionBy("shard").orderBy(F.xxhash64("key", "copy", F.lit(seed)), "key", "copy")
    return sizes.join(placed, ["source", "block"]).select(F.col("key").alias(key), "source", "copy", "shard", F.row_number().over(place).alias("pos"), "n_tokens")
