"""Queries of sources, sinks, reports and the whole run: what was written is read again and compared with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlens.functions.topics import TOPIC_KEYWORDS, topic_count, topic_list
from growthlens.functions.values import NA_TOKENS, to_number, whole_or
from growthlens.operators import clean, profile
from growthlens.plans import reference_queries as ref
from growthlens.plans.pipeline import Pipeline
from growthlens.plans.reports import REPORT, distribution_lines, load_summary, run_report
from growthlens.session import place
from growthlens.sources.contracts import TABLES
from growthlens.sources.readers import import_tables, read_csv, read_processed, read_tables
from growthlens.sources.sinks import replace_table, shape, write_csv
from growthlens.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def imported(name: str) -> Query:
    """A table written as the delimited file of its contract and imported again."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        path = place(spark)
        write_csv(table(spark, folder, name), f"{path}/{TABLES[name].file}")
        return ref.unzoned(import_tables(spark, path, tables=[name])[name])

    return query


def missing_files(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of an import when a file is missing, by policy."""
    path = place(spark)
    write_csv(table(spark, folder, "herd_modeling"), f"{path}/{TABLES['herd_modeling'].file}")
    rows = [("skip", name) for name in import_tables(spark, path, on_missing="skip")]
    try:
        rows += [("error", name) for name in import_tables(spark, path)]
    except FileNotFoundError as e:
        rows.append(("error", type(e).__name__))
    return spark.createDataFrame(rows, "policy string, outcome string")


def replaced_table(spark: SparkSession, folder: str) -> DataFrame:
    """A table created, then replaced by another of its columns; read back under its name."""
    herd, name = table(spark, folder, "herd_modeling"), "growthlens_replaced"
    rows = []
    for step, df in enumerate((herd.select("repo_id", "language"), herd.select("license").distinct())):
        replace_table(df, name)
        rows.append((step, *shape(spark.table(name))))
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame(rows, "step int, n_rows bigint, n_columns int")


def processed_hop(spark: SparkSession, folder: str) -> DataFrame:
    """Known values of each column of a cleaned table after its hop through text: no-value texts are null again."""
    path = place(spark)
    write_csv(clean.clean_herd(table(spark, folder, "herd_modeling")), path)
    back = read_processed(spark, path)
    known = back.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in back.columns))
    return known.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("known")) for c in back.columns))).alias("e")).select("e.*")


def profile_csv(spark: SparkSession, folder: str) -> DataFrame:
    """A profiling table as its one file, read again."""
    path = place(spark)
    languages = profile.value_counts(ref.language_filled(table(spark, folder, "repositories")), "language", "repo_count")
    write_csv(profile.top_k(languages, "repo_count", 10, ["language"]), path, one_file=True)
    return read_csv(spark, path).select("language", F.col("repo_count").try_cast("bigint").alias("repo_count"))


def lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "line_no int, line string")


def report_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The fixed-width text of a part of the SQL report."""
    read_tables(spark, folder, ["repositories"])
    titles = ("Total Repositories", "Top 10 Programming Languages")
    return lines(spark, run_report(spark, suite={t: REPORT[t] for t in titles}))


def load_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, load_summary({n: table(spark, folder, n) for n in TABLES}))


def star_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the profiling report on the stars' distribution."""
    return lines(spark, "\n".join(distribution_lines(table(spark, folder, "repositories"), "stars_count")))


def pipeline_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and columns of every table that the whole run writes."""
    target = place(spark)
    run = Pipeline(spark, folder, target, kind="parquet")
    run.run(say=lambda stage: None)
    names = {"interim": list(run.tables), "processed": list(run.cleaned), "features": ["repositories_feature_engineered", "weekly_timeseries_features", "recommendation_features", "herd_features_unscaled", "herd_model_ready"]}
    rows = [(stage, n, *shape(spark.read.parquet(f"{target}/{stage}/{n}"))) for stage, own in names.items() for n in own]
    return spark.createDataFrame(rows, "stage string, name string, n_rows bigint, n_columns int")


#: Texts of numbers, by the remainder of repo_id by 8, with the number and the whole number (1 where there is none) that they say.
NUMBERS = [("3000000000", "3000000000", "3000000000"), ("inf", "'inf'", "1"), ("NaN", "NULL", "1"), ("2.7", "2.7", "2"), ("-2.7", "-2.7", "-2"), ("x", "NULL", "1"), (None, "NULL", "1"), ("1e30", "1e30", "1")]
#: Lists of topics, by the remainder of repo_id by 6, with their number and topics; # stands for repo_id.
LITERALS = [("['T#',]", 1, "t#"), ("['T#' 'b']", 1, "t#b"), ("['T#', \"b c\"]", 2, "t#|b c"), ("[T#, b]", 2, "[t#|b]"), ("[1, None, 'it\\'s T#']", 3, "1|none|it's t#"), ("T#,,b", 2, "t#|b")]


def numeric_dirty(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "repositories").where("repo_id is not null")
    text = F.get(F.array(*(F.lit(t).cast("string") for t, _, _ in NUMBERS)), F.pmod(F.col("repo_id"), F.lit(8)).cast("int"))
    return df.select("repo_id", to_number(text).alias("number"), whole_or(text, 1).alias("whole"))


def topic_literals(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "repositories").where("repo_id is not null")
    text = F.replace(F.get(F.array(*(F.lit(t) for t, _, _ in LITERALS)), F.pmod(F.col("repo_id"), F.lit(6)).cast("int")), F.lit("#"), F.col("repo_id").cast("string"))
    return df.select("repo_id", topic_count(text).alias("topic_count"), F.array_join(topic_list(text), "|").alias("topics"))


def histogram50_edges(spark: SparkSession, folder: str) -> DataFrame:
    return profile.histogram(table(spark, folder, "repositories"), "stars_count")


def queries() -> dict[str, Query]:
    every = [missing_files, replaced_table, processed_hop, profile_csv, report_lines, load_lines, star_lines, pipeline_outputs, numeric_dirty, topic_literals, histogram50_edges]
    return {f"import_{n}": imported(n) for n in TABLES} | {q.__name__: q for q in every}


# --- SQL ---------------------------------------------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def known_sql(column: str, kind: str) -> str:
    """A column after its hop through text."""
    if kind == "string":
        return f"CASE WHEN {column} NOT IN ({', '.join(map(quoted, NA_TOKENS))}) THEN {column} END AS {column}"
    if kind == "double":
        return f"CASE WHEN NOT isnan({column}) THEN {column} END AS {column}"
    return f"CAST({column} AS BIGINT) AS {column}" if kind == "bigint" else column


def imported_sql(name: str) -> str:
    return f"SELECT {', '.join(known_sql(*c.split()) for c in TABLES[name].ddl.split(', '))} FROM {name}"


def oracle_sql() -> dict[str, str]:
    cleaned = ref.oracle_sql()
    known = lambda c, kind: f"count(CASE WHEN CAST({c} AS VARCHAR) NOT IN ({', '.join(map(quoted, NA_TOKENS))}) THEN 1 END)"
    herd_columns = [*(c.split()[0] for c in TABLES["herd_modeling"].ddl.split(", ")), "topic_count"]
    sizes = {"repositories": 42, "stars": 7, "user_repo_interactions": 6, "daily_timeseries": 6, "weekly_timeseries": 9, "herd_modeling": 22}
    count = lambda stage, name, source, columns: f"SELECT '{stage}' AS stage, '{name}' AS name, count(*) AS n_rows, CAST({columns} AS INT) AS n_columns FROM {source}"
    stages = [count("interim", n, n, len(ref.all_names(n))) for n in TABLES] + [count("processed", n, n, c) for n, c in sizes.items()]
    dummies = "(SELECT count(DISTINCT language_grouped) + count(DISTINCT license_grouped) FROM grouped)"
    stages += [
        count("features", "repositories_feature_engineered", "repositories", 42 + len(TOPIC_KEYWORDS)),
        count("features", "weekly_timeseries_features", "weekly WHERE repo_id IS NOT NULL AND week_start IS NOT NULL", 15),
        count("features", "recommendation_features", "user_repo_interactions i LEFT JOIN repositories r ON i.repo_id = r.repo_id", 12),
        count("features", "herd_features_unscaled", "herd_modeling", 22 + len(TOPIC_KEYWORDS) + 4),
        count("features", "herd_model_ready", "herd_modeling", f"2 + {len(ref.PREDICTORS)} + {dummies}"),
    ]
    star_stats = [("Minimum", "CAST(min(stars_count)::DOUBLE AS VARCHAR)"), ("Maximum", "CAST(max(stars_count)::DOUBLE AS VARCHAR)"), ("Mean", "format('{:.2f}', avg(stars_count))"), ("Median", "format('{:.2f}', median(stars_count))")]
    by_rest = lambda cases: "CASE {}" + " ".join(f" WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"
    by_8 = lambda k: by_rest([f"{n[k]}::DOUBLE" if k == 1 else f"{n[k]}::BIGINT" for n in NUMBERS]).format("repo_id % 8")
    line = "=" * 80
    return {f"import_{n}": imported_sql(n) for n in TABLES} | {
        "missing_files": "SELECT 'skip' AS policy, 'herd_modeling' AS outcome UNION ALL SELECT 'error', 'FileNotFoundError'",
        "replaced_table": "SELECT CAST(0 AS INT) AS step, count(*) AS n_rows, CAST(2 AS INT) AS n_columns FROM herd_modeling UNION ALL SELECT 1, count(*), 1 FROM (SELECT DISTINCT license FROM herd_modeling)",
        "processed_hop": f"WITH h AS ({cleaned['clean_herd_modeling']}) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {known(c, None)} AS known FROM h" for c in herd_columns),
        "profile_csv": "SELECT coalesce(language, 'Unknown') AS language, count(*) AS repo_count FROM repositories GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "report_lines": f"""WITH t AS ({REPORT['Top 10 Programming Languages']}),
            w AS (SELECT greatest(max(length(language)), length('language')) AS a, greatest(max(length(CAST(repo_count AS VARCHAR))), length('repo_count')) AS b FROM t),
            n AS (SELECT CAST(count(*) AS VARCHAR) AS n FROM repositories),
            body AS (SELECT string_agg(lpad(language, CAST(a AS INT), ' ') || ' ' || lpad(CAST(repo_count AS VARCHAR), CAST(b AS INT), ' '), chr(10) ORDER BY repo_count DESC, language) AS x FROM t, w),
            whole AS (SELECT concat_ws(chr(10), '{line}', 'Total Repositories', '{line}', lpad('num_repositories', CAST(greatest(length(n), 16) AS INT), ' '), lpad(n, CAST(greatest(length(n), 16) AS INT), ' '), '',
                '{line}', 'Top 10 Programming Languages', '{line}', lpad('language', CAST(a AS INT), ' ') || ' ' || lpad('repo_count', CAST(b AS INT), ' '), x, '', '') AS text FROM n, w, body)
            SELECT CAST(i AS INT) AS line_no, l[i] AS line FROM (SELECT l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT string_split(text, chr(10)) AS l FROM whole))""",
        "load_lines": " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS line_no, '{n}: ' || count(*) || ' rows, {len(ref.all_names(n))} columns' AS line FROM {n}" for i, n in enumerate(TABLES, 1)),
        "star_lines": " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS line_no, '{label} stars_count: ' || {x} AS line FROM repositories" for i, (label, x) in enumerate(star_stats, 1)),
        "pipeline_outputs": f"WITH {ref.HERD}, {ref.WEEKLY} " + " UNION ALL ".join(stages),
        "numeric_dirty": f"SELECT repo_id, {by_8(1)} AS number, {by_8(2)} AS whole FROM repositories WHERE repo_id IS NOT NULL",
        "topic_literals": f"""SELECT repo_id, CAST({by_rest([n for _, n, _ in LITERALS]).format('repo_id % 6')} AS INT) AS topic_count,
            replace({by_rest([quoted(t) for _, _, t in LITERALS]).format('repo_id % 6')}, '#', CAST(repo_id AS VARCHAR)) AS topics FROM repositories WHERE repo_id IS NOT NULL""",
        "histogram50_edges": """WITH r AS (SELECT min(stars_count)::DOUBLE AS lo, (max(stars_count) - min(stars_count))::DOUBLE / 50 AS w FROM repositories),
            c AS (SELECT CAST(least(floor((stars_count - lo) / w), 49) AS INT) AS bin, count(*) AS n FROM repositories, r WHERE stars_count IS NOT NULL GROUP BY 1)
            SELECT CAST(b.bin AS INT) AS bin, lo + b.bin * w AS low, lo + (b.bin + 1) * w AS high, coalesce(c.n, 0) AS n FROM range(50) b(bin) CROSS JOIN r LEFT JOIN c ON b.bin = c.bin""",
    }
