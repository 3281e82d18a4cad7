"""Sources, sinks, cleaning, features, reports, pipeline and streaming."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from growthlens.operators import clean, derive, features, profile
from growthlens.plans import reports
from growthlens.plans.figures import draw, figures
from growthlens.plans.pipeline import Pipeline, build_features
from growthlens.sources.contracts import TABLES, key_violations
from growthlens.sources.readers import import_tables, read_csv, read_processed, read_tables, run_sql
from growthlens.sources.sinks import few_rows, fixed_width, replace_table, write_csv, write_parquet, write_text
from growthlens.streaming.counts import windowed_counts

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(SMALL), reason="no test tables here")


# oracle ----------------------------------------------------------------------------------------


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SMALL) if os.path.exists(SMALL) else []:
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SMALL}/{f}')")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("p4_")))
def test_query_equals_sql(spark, duck, name):
    got, expected = entry.queries()[name](spark, SMALL).toArrow(), duck.sql(entry.oracle_sql()[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(expected.column_names)
    bare = lambda v: v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v
    values = lambda t: sorted(map(repr, zip(*([bare(v) for v in t.column(c).to_pylist()] for c in columns))))
    assert values(got) == values(expected)


@needs_data
def test_null_totals_of_all_cleaned_tables(spark):
    totals = {r["table"]: r["total_missing_values"] for r in entry.queries()["null_totals_cleaned"](spark, SMALL).collect()}
    assert set(totals) == set(TABLES)
    for name, total in totals.items():
        cleaned = entry.queries()[f"clean_{name}"](spark, SMALL).toArrow()
        assert total == sum(c.null_count for c in cleaned.columns), name


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


# sources and sinks -----------------------------------------------------------------------------


def write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / name)


def test_read_csv(spark, tmp_path):
    path = write(tmp_path, "x.csv", 'repo_id,description,archived,stars_count,created_at,extra\n1,"two\nlines, ""q""",True,3.0,2025-01-02T03:04:05Z,NA\nx,None,0,,nope,1\n')
    r = read_csv(spark, path, TABLES["repositories"].schema).orderBy(F.col("repo_id").desc()).collect()
    assert (r[0]["repo_id"], r[0]["description"], r[0]["archived"], r[0]["stars_count"], str(r[0]["created_at"]), r[0]["extra"]) == (1, 'two\nlines, "q"', 1, 3, "2025-01-02 03:04:05", None)
    assert (r[1]["repo_id"], r[1]["description"], r[1]["archived"], r[1]["stars_count"], r[1]["created_at"], r[1]["extra"]) == (None, None, 0, None, None, "1")


def test_import_tables(spark, tmp_path):
    write(tmp_path, "stars_raw.csv", "repo_id,user_id\n1,2\n1,2\n,3\n")
    write(tmp_path, "other.csv", "a\n1\n")
    with pytest.raises(FileNotFoundError):
        import_tables(spark, str(tmp_path))
    with pytest.warns(UserWarning):
        found = import_tables(spark, str(tmp_path), on_missing="skip")
    assert list(found) == ["stars"] and run_sql(spark, "SELECT count(*) AS n FROM stars;").first()["n"] == 3
    assert {tuple(r) for r in run_sql(spark, key_violations(TABLES["stars"])).collect()} == {(1, 2, 2), (None, 3, 1)}


def test_processed_hop_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b\n", dt.datetime(2025, 1, 1), None), (2, "NA", None, 1.5)], "i int, s string, t timestamp, x double")
    write_csv(df, str(tmp_path / "c"), one_file=True)
    back = read_processed(spark, str(tmp_path / "c"))
    kinds = dict(back.dtypes)
    assert kinds["t"] == "string" and kinds["x"] == "double" and {r["s"] for r in back.collect()} == {"a,b\n", None}
    write_parquet(df, str(tmp_path / "p"), ["i"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    with pytest.raises(ValueError):
        few_rows(spark.range(5), 4)
    assert fixed_width(spark.createDataFrame([(1, "long name", 0.5), (20, None, None)], "a int, b string, c double")) == " a         b        c\n 1 long name 0.500000\n20      None     None"
    assert "Empty" in fixed_width(df.limit(0))


def test_write_text(spark, tmp_path):
    for path in (str(tmp_path / "a/b.txt"), f"file://{tmp_path}/c.txt"):
        write_text("é\n", path)
    assert (tmp_path / "a/b.txt").read_bytes() == (tmp_path / "c.txt").read_bytes() == "é\n".encode()


def test_replace_table(spark):
    for n in (3, 2):
        replace_table(spark.range(n).withColumnRenamed("id", "k"), "growthlens_test_table", ("k",), 2)
    assert spark.table("growthlens_test_table").count() == 2
    spark.sql("DROP TABLE growthlens_test_table")


# profile ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("accuracy,at_once", [(10_000, 4_000_000), (20, 100), (5, 1), (10, 10_000)])
def test_exact_percentiles(spark, accuracy, at_once):
    import random

    random.seed(1)
    data = [(random.choice([None, float("nan"), 5.0, random.random() * 100]), random.randrange(10), None) for _ in range(3000)]
    df = spark.createDataFrame(data, "a double, `b.c` int, d double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    expected = df.where("not isnan(a)").agg(F.percentile("a", F.array(*map(F.lit, shares)))).first()[0], df.agg(F.percentile("`b.c`", F.array(*map(F.lit, shares)))).first()[0]
    got, stats = profile.ranked(df, ["a", "b.c", "d"], shares, {"most": F.max}, accuracy, at_once)
    assert got["a"] == pytest.approx(expected[0], rel=1e-15) and got["b.c"] == expected[1] and got["d"] == [None] * 7
    assert stats["b.c"] == {"n": 3000, "most": 9.0} and stats["d"] == {"n": 0, "most": None}
    few = spark.createDataFrame([(1,), (2,), (4,), (9,)], "x int")
    assert profile.ranked(few, ["x"], [0.25, 0.5, 0.75], None, accuracy, at_once)[0] == {"x": [1.75, 3.0, 5.25]}
    assert profile.exact_percentiles(few.limit(0), ["x"], [0.5]) == {"x": [None]} and profile.exact_percentiles(few, [], [0.5]) == {}


def test_profile_edges(spark):
    df = spark.createDataFrame([(1, None, True), (1, "x", None)], "n int, s string, f boolean")
    assert profile.numeric_columns(df) == ["n"] and profile.numeric_columns(df, flags=True) == ["n", "f"]
    d = profile.describe_numeric(df).first()
    assert (d["column"], d["count"], d["mean"], d["std"], d["p50"]) == ("n", 2, 1.0, 0.0, 1.0)
    assert profile.describe_numeric(df.limit(1)).first()["std"] is None
    assert {tuple(r) for r in profile.null_profile({"t": df}).collect()} == {("t", "n", 0, 0.0), ("t", "s", 1, 50.0), ("t", "f", 1, 50.0)}
    assert {r["missing_percent"] for r in profile.null_profile({"t": df.limit(0)}).collect()} == {None}
    h = profile.histogram(df, "n", 4).orderBy("bin").collect()
    assert [r["n"] for r in h] == [0, 0, 2, 0] and h[0]["low"] == 0.5
    h = profile.histogram(spark.createDataFrame([(0,), (5,), (10,), (10,), (None,)], "n int"), "n", 2).orderBy("bin").collect()
    assert [r["n"] for r in h] == [1, 3] and profile.histogram(df.limit(0), "n").count() == 0


# cleaning and features -------------------------------------------------------------------------


def synthetic(spark, name, n=40):
    """A table of the contract with some nulls, made from the row number."""
    kinds = {"bigint": "id", "int": "cast(id % 2 as int)", "double": "id / 3.0d", "boolean": "id % 2 = 0", "date": "date_add(date'2025-01-06', cast(7 * id as int))", "timestamp": "timestamp_seconds(1700000000 + id * 86400)", "string": "concat('v', id % 12)"}
    columns = [c.split() for c in TABLES[name].ddl.split(", ")]
    exprs = [f"CASE WHEN id % 7 <> 3 OR '{c}' IN ('repo_id', 'user_id') THEN {kinds[k]} END AS {c}" for c, k in columns]
    df = spark.range(n).selectExpr(*exprs)
    if name == "weekly_timeseries":
        df = df.withColumn("week", F.expr("concat(date_add(date'2025-01-06', cast(7 * repo_id as int)), '/', date_add(date'2025-01-12', cast(7 * repo_id as int)))"))
    return df


def test_shapes(spark):
    cleaned = clean.clean_all({n: synthetic(spark, n) for n in TABLES})
    assert {n: len(df.columns) for n, df in cleaned.items()} == {"repositories": 42, "stars": 7, "user_repo_interactions": 6, "daily_timeseries": 6, "weekly_timeseries": 9, "herd_modeling": 22}
    made = build_features(cleaned)
    assert {n: len(df.columns) for n, df in made.items()} == {"repositories_feature_engineered": 48, "weekly_timeseries_features": 15, "recommendation_features": 12, "herd_features_unscaled": 32, "herd_model_ready": 31}
    model = made["herd_model_ready"].toPandas()
    for group in ("language_grouped_", "license_grouped_"):
        assert sum(c.startswith(group) for c in model.columns) == (9 if "lang" in group else 7)
    scaled = model.drop(columns=["repo_id", "became_high_growth"])
    assert (scaled.mean().abs() < 1e-9).all() and set(scaled.std(ddof=0).round(9)) <= {0.0, 1.0}
    numbers = [*clean.REPOSITORY_NUMBERS, "has_homepage", "homepage", "description", "language", "license", "topics"]
    assert sum(r["missing_count"] for r in profile.null_profile({"r": cleaned["repositories"].select(*numbers)}).collect()) == 0


def test_rules_follow_the_columns(spark):
    df = spark.createDataFrame([(1, None)], "repo_id int, language string")
    assert clean.clean_repositories(df).collect() == [(1, "Unknown")]
    assert features.group_rare(df, "license", 6, "g", "No License").first()["g"] == "No License"
    assert clean.impute_medians(spark.createDataFrame([(None,), (1.0,), (4.0,)], "x double"), ["x", "y"]).orderBy("x").collect() == [(1.0,), (2.5,), (4.0,)]
    assert clean.impute_medians(spark.createDataFrame([(None,)], "x double"), ["x"]).collect() == [(None,)]


def test_weekly_windows(spark):
    week = lambda i: f"{dt.date(2024, 12, 16) + dt.timedelta(days=7 * i)}/x"  # noqa: E731  crosses the year
    data = [(1, week(i), v, v) for i, v in enumerate([5, 7, 1, 4])] + [(2, week(0), 9, 9), (None, week(0), 1, 1), (1, "nope", 1, 1), (3, week(1), None, None)]
    got = features.weekly_features(spark.createDataFrame(data, "repo_id int, week string, weekly_new_stars int, cumulative_stars int")).orderBy("repo_id", "week_start").collect()
    of = lambda c, k: [r[c] for r in got if r["repo_id"] == k]
    assert of("lag_1_week_stars", 1) == [0, 5, 7, 1] and of("lag_2_week_stars", 1) == [0, 0, 5, 7]
    assert of("rolling_3week_mean_stars", 1) == [5, 6, pytest.approx(13 / 3), 4] and of("rolling_4week_sum_stars", 1) == [5, 12, 13, 17]
    assert of("weekly_growth_acceleration", 1) == [0, 2, -6, 3] and of("cumulative_growth_lag_1", 1) == [0, 5, 7, 1]
    assert of("rolling_3week_mean_stars", 2) == [9] and of("rolling_4week_sum_stars", 3) == [0] and len(got) == 6


def test_counts_and_side(spark, rows):
    inter = spark.createDataFrame([("u1", "r1"), ("u1", "r2"), ("u2", "r1"), (None, "r9")], "user_id string, repo_id string")
    repos = spark.createDataFrame([("r1", "Go", 1, 5, 2), ("r2", None, None, None, None)], "repo_id string, language string, topic_count int, stars_count int, forks_count int")
    got = rows(features.recommendation_features(inter, repos))
    assert got == [(None, "r9", 0, 1, "Unknown", 0, 0, 0), ("u1", "r1", 2, 2, "Go", 1, 5, 2), ("u1", "r2", 2, 1, "Unknown", 0, 0, 0), ("u2", "r1", 1, 2, "Go", 1, 5, 2)]


def test_grouping_one_hot_scaler(spark):
    df = spark.createDataFrame([(x,) for x in "aaabbc"] + [(None,)], "v string")
    out = features.one_hot(features.group_rare(df, "v", 2, "g", "none"), ["g"])
    assert out.columns == ["v", "g_Other", "g_a", "g_b"] and sorted((r["v"] or "-", r["g_Other"]) for r in out.collect() if r["g_Other"]) == [("-", 1), ("c", 1)]
    with pytest.raises(ValueError):
        features.one_hot(df, ["v"], most=2)
    s = features.Scaler.fit(spark.createDataFrame([(1, 7), (2, 7), (4, 7)], "x int, y int"), ["x", "y"])
    got = s.transform(spark.createDataFrame([(1, 7), (2, 7), (4, 7)], "x int, y int")).orderBy("x").collect()
    assert [r["x"] for r in got] == pytest.approx([-1.069045, -0.267261, 1.336306], abs=1e-6) and {r["y"] for r in got} == {0.0}


def test_derived_series(spark):
    at = lambda d: dt.datetime(2025, 1, d, 12)
    events = spark.createDataFrame([(1, at(6)), (1, at(12)), (1, at(13)), (1, at(27)), (None, at(6)), (1, None), (2, at(6))], "repo_id int, starred_at timestamp")
    weekly = derive.derive_weekly(events).where("repo_id = 1").orderBy("week_start").collect()
    assert [(r["weekly_new_stars"], r["cumulative_stars"], r["previous_week_stars"], r["weekly_growth_rate"], r["herd_momentum_score"]) for r in weekly] == [(2, 2, None, None, 0.0), (1, 3, 2, -0.5, 6.0), (1, 4, 1, 0.0, 4.0)]
    assert weekly[0]["week"] == "2025-01-06/2025-01-12"
    herd = derive.growth_target(derive.early_later(derive.derive_weekly(events), early=2)).orderBy("repo_id").collect()
    assert [(r["early_4week_stars"], r["later_stars"], r["later_avg_weekly_stars"], r["became_high_growth"]) for r in herd] == [(3, 1, 1.0, 1), (1, 0, 0.0, 0)]
    assert derive.derive_daily(events.limit(0)).count() == 0


# whole runs ------------------------------------------------------------------------------------


def test_pipeline_from_csv(spark, tmp_path):
    source = tmp_path / "raw"
    source.mkdir()
    for name, spec in TABLES.items():
        synthetic(spark, name).toPandas().to_csv(source / spec.file, index=False)
    run = Pipeline(spark, str(source), str(tmp_path / "out"), csv=True)
    said = []
    assert run.run(said.append) == ["load", "report", "summarise", "profile", "clean", "features"] and len(said) == 6
    text = (tmp_path / "out/reports/sql_query_outputs.txt").read_text()
    assert text.startswith("=" * 80 + "\nTotal Repositories\n") and text.count("=" * 80) == 18
    assert "repositories: 40 rows, 30 columns" in (tmp_path / "out/reports/load_data_summary.txt").read_text()
    assert "herd_model_ready: 40 rows, 31 columns" in (tmp_path / "out/reports/feature_engineering_summary.txt").read_text()
    assert "Minimum stars_count" in (tmp_path / "out/reports/eda_summary.txt").read_text()
    assert reports.run_report(spark, suite=reports.CHECKS, width=50).count("=" * 50) == 8
    broken = Pipeline(spark, str(tmp_path / "none"), str(tmp_path / "out2"))
    with pytest.raises(FileNotFoundError):
        broken.run(said.append)
    assert broken.done == []


@needs_data
def test_figures(spark, tmp_path):
    made = figures(read_tables(spark, SMALL))
    assert len(made) == 8
    for name, figure in made.items():
        assert {figure.x, figure.y} <= set(figure.data.columns) and figure.data.count() > 0, name
    assert draw(made["top_languages"], str(tmp_path / "f.png")) in (True, False)


def test_stream_counts_equal_batch(spark, tmp_path):
    events = spark.createDataFrame([(1, 1, dt.datetime(2025, 1, 6 + i % 20, 5)) for i in range(60)] + [(None, 1, dt.datetime(2025, 1, 6)), (1, 2, None)], "repo_id int, user_id int, starred_at timestamp")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in windowed_counts(events, unique=["repo_id", "user_id"]).collect()}
    assert batch == {(1, dt.date(2025, 1, 6), 7), (1, dt.date(2025, 1, 13), 7), (1, dt.date(2025, 1, 20), 6)}
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("stream_counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("stream_counts").collect()} == {tuple(r) for r in windowed_counts(events).collect()}
