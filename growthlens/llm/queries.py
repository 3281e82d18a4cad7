"""Queries p4, p8, p9 and p10, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlens.llm.cooccurrence import together
from growthlens.llm.encode import encode_texts
from growthlens.llm.mixing import grain, mix_report, mix_sources, plain_source
from growthlens.llm.splitting import split_oversized
from growthlens.sources.tables import table

#: The chi-square distribution's value of one degree of freedom that chance exceeds once in a thousand times.
ONE_IN_A_THOUSAND = 10.828


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs with 5 common users, a fifth of all users of either, and three times what chance gives."""
    return pairs(spark, folder, 5, 0.2, 3.0).select("repo_a", "repo_b")


def pairs(spark: SparkSession, folder: str, min_count: int, min_jaccard: float, min_lift: float, min_llr: float = 0.0) -> DataFrame:
    found = together(table(spark, folder, "user_repo_interactions"), "user_id", "repo_id", min_count, min_jaccard, min_lift, min_llr)
    return found.withColumnsRenamed({"item_a": "repo_a", "item_b": "repo_b"})


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair with a common user, however rare or unequal in size, and how far it exceeds chance."""
    return pairs(spark, folder, 1, 0.0, 0.0).select("repo_a", "repo_b", "k", "a", "b", "n", F.round("lift", 6).alias("lift"), F.round("llr", 6).alias("llr"))


def p4_significant(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs that are together more often than chance makes likelier than one in a thousand, by their log-likelihood ratio alone."""
    return pairs(spark, folder, 1, 0.0, 0.0, ONE_IN_A_THOUSAND).select("repo_a", "repo_b", "k", F.round("lift", 6).alias("lift"), F.round("llr", 6).alias("llr"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"), ["doc_id"], "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that cannot fill their target share within max_repeats."""
    return p9_shares(spark, folder).where("short").select("source")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix_report(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), "doc_id", "text")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), "doc_id", "text")


def p9_mix_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Per source, what holds of every mixture: its documents; none drawn too often; its tokens short of the quota by less than the smallest block left out; every shard filled."""
    mix, report = p9_mix(spark, folder), p9_shares(spark, folder)
    docs = table(spark, folder, "documents").groupBy(plain_source(F.col("source")).alias("source")).agg(F.count("*").alias("documents"))
    drawn = mix.groupBy("source", "doc_id").agg(F.count("*").alias("times"), F.count_distinct("copy").alias("copies"), F.max("n_tokens").alias("n"))
    by_source = drawn.groupBy("source").agg(F.max("times").alias("most"), F.bool_and(F.col("times") == F.col("copies")).alias("distinct_copies"), F.sum(F.col("n") * F.col("times")).alias("tokens_drawn"))
    quota = F.least("wanted_tokens", F.col("tokens") * F.col("max_repeats"))
    shards = mix.agg(F.count_distinct("shard").alias("n")).scalar()
    _, expected = grain(table(spark, folder, "documents"), 1, None, None)
    return (
        report.join(docs, "source", "left").join(by_source, "source", "left")
        .select(
            "source", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce((F.col("most") <= F.col("max_repeats")) & F.col("distinct_copies"), F.lit(True)).alias("within_repeats"),
            ((F.coalesce("tokens_drawn", F.lit(0)) == F.col("drawn_tokens")) & (F.col("drawn_tokens") <= quota) & ((quota - F.col("drawn_tokens") < F.col("smallest_left")) | F.col("smallest_left").isNull())).alias("within_quota"),
            (shards == expected).alias("all_shards"),
        )
    )


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that had to be cut: those with a first piece."""
    return p10_pieces(spark, folder).where("piece_no = 1").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [p4_found, p4_pairs, p4_significant, p8_ids, p9_found, p9_shares, p9_mix, p9_mix_invariants, p10_found, p10_pieces]
    return {q.__name__: q for q in every}


PAIRS_SQL = """WITH p AS (SELECT DISTINCT user_id AS u, repo_id AS r FROM user_repo_interactions WHERE user_id IS NOT NULL AND repo_id IS NOT NULL),
    c AS (SELECT r, count(*) AS s FROM p GROUP BY 1), q AS (SELECT p.u, p.r, c.s FROM p JOIN c ON p.r = c.r),
    users AS (SELECT count(DISTINCT u) AS n FROM p),
    j AS (SELECT x.r AS repo_a, y.r AS repo_b, count(*) AS k, any_value(x.s) AS a, any_value(y.s) AS b FROM q x JOIN q y ON x.u = y.u AND x.r < y.r GROUP BY 1, 2),
    f AS (SELECT j.*, users.n FROM j, users)"""


def oracle_sql() -> dict[str, str]:
    term = lambda seen, row, column: f"CASE WHEN {seen} > 0 THEN {seen} * ln(CAST({seen} AS DOUBLE) * n / (CAST({row} AS DOUBLE) * ({column}))) ELSE 0.0 END"
    llr = " + ".join([term("k", "a", "b"), term("(a - k)", "a", "n - b"), term("(b - k)", "(n - a)", "b"), term("(n - a - b + k)", "(n - a)", "n - b")])
    lift = "round(k * n / (CAST(a AS DOUBLE) * b), 6)"
    return {
        "p4_found": f"{PAIRS_SQL} SELECT repo_a, repo_b FROM f WHERE k >= 5 AND 5 * k >= a + b - k AND k * n >= 3 * a * b",
        "p4_pairs": f"{PAIRS_SQL} SELECT repo_a, repo_b, k, a, b, n, {lift} AS lift, round(2 * ({llr}), 6) AS llr FROM f",
        "p9_mix_invariants": r"""WITH d AS (SELECT replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '-', '_') AS s, count(*) AS n FROM documents GROUP BY 1)
            SELECT t.source, max_repeats, coalesce(d.n, 0) AS documents, TRUE AS within_repeats, TRUE AS within_quota, TRUE AS all_shards
            FROM (SELECT replace(lower(trim(source)), '-', '_') AS source, max_repeats FROM mix_targets) t LEFT JOIN d ON t.source = d.s""",
        "p4_significant": f"{PAIRS_SQL} SELECT repo_a, repo_b, k, {lift} AS lift, round(2 * ({llr}), 6) AS llr FROM f WHERE 2 * ({llr}) >= {ONE_IN_A_THOUSAND} AND k * n > a * b",
    }
