"""Operators of the general problems: nulls, repeats, ties, empty tables, clashing columns, hot keys."""

import datetime as dt
import os
import random
import subprocess
import sys
from types import SimpleNamespace

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from growthlens import session
from growthlens.operators.grid import DAY, MONDAY, interval_grid
from growthlens.operators.heavy_keys import key_totals
from growthlens.operators.joins import spread_join, with_halo
from growthlens.operators.orphans import find_orphans
from growthlens.operators.packed import BARE, QUOTED, Segmenter, known_forms, split_packed, unquote
from growthlens.operators.rolling import trailing_totals
from growthlens.operators.spikes import implausible, outside, phase_space_spikes, stuck_runs

D = dt.date
AT = dt.datetime


# grid ------------------------------------------------------------------------------------------


def test_grid_days(spark, rows):
    data = [(1, D(2025, 1, 1), 4, "x"), (1, D(2025, 1, 1), 6, "y"), (1, D(2025, 1, 4), 8, None), (2, D(2025, 1, 1), None, ""), (None, D(2025, 1, 1), 1, ""), (1, None, 1, "")]
    df = spark.createDataFrame(data, "k int, cell_start date, v int, coverage string")  # other columns may clash
    got = rows(interval_grid(df, "k", "cell_start", "v").select("k", F.col("cell_start").cast("date"), "coverage", "held", "mean_value", "filled"))
    assert got == [
        (1, D(2025, 1, 1), 1.0, 0.0, 6.0, False),
        (1, D(2025, 1, 2), 0.0, 1.0, 6.0, True),
        (1, D(2025, 1, 3), 0.0, 1.0, 6.0, True),
        (1, D(2025, 1, 4), 1.0, 0.0, 8.0, False),
    ]
    assert interval_grid(df.limit(0), "k", "cell_start", "v").count() == 0


def test_grid_time_weighted(spark, rows):
    data = [(1, AT(2025, 1, 1, 18), 10.0), (1, AT(2025, 1, 2, 6), 20.0), (1, AT(2025, 1, 2, 6), 15.0), (1, AT(2025, 1, 4, 12), 0.0)]
    df = spark.createDataFrame(data, "k int, t timestamp, v double")
    got = rows(interval_grid(df, "k", "t", "v", span=6 * 3600, max_hold=24 * 3600).select(F.dayofmonth("cell_start").alias("d"), "coverage", "held", "mean_value"))
    # day 1: 10 for 6 h measured; day 2: 10 held 6 h, 20 measured 6 h and held 12 h; day 3: held to 06:00; day 4: measured 12:00-18:00
    assert got[0] == (1, 0.25, 0.0, 10.0)
    assert got[1][:3] == (2, 0.25, 0.75) and got[1][3] == pytest.approx((10 * 6 + 20 * 18) / 24)
    assert got[2] == (3, 0.0, 0.25, 20.0)
    assert got[3] == (4, 0.25, 0.0, 0.0)


def test_grid_chunks_do_not_matter(spark, rows):
    random.seed(3)
    data = [(k, D(2020, 1, 1) + dt.timedelta(days=random.randrange(900)), random.randrange(9)) for k in range(3) for _ in range(60)]
    df = spark.createDataFrame(data, "k int, d date, v int")
    one = rows(interval_grid(df, "k", "d", "v", cell=7 * DAY, anchor=MONDAY))
    assert one == rows(interval_grid(df, "k", "d", "v", cell=7 * DAY, anchor=MONDAY, chunk_cells=3))
    monday = lambda d: d - dt.timedelta(days=d.weekday())
    # the last reading is valid for seven days, which reach into the next week
    assert len(one) == sum((monday(max(x) + dt.timedelta(days=6)) - monday(min(x))).days // 7 + 1 for x in ([d for k, d, _ in data if k == j] for j in range(3)))


# rolling ---------------------------------------------------------------------------------------


def test_trailing_totals_against_loops(spark):
    random.seed(1)
    days = {k: {random.randrange(120): random.randrange(20) for _ in range(n)} for k, n in ((1, 1), (2, 30), (3, 90))}
    data = [(k, D(2024, 1, 1) + dt.timedelta(days=d), v, "o") for k, x in days.items() for d, v in x.items()]
    data += [(2, D(2024, 1, 1), None, ""), (None, D(2024, 1, 1), 1, ""), (3, None, 1, "")] + data[:5]
    df = spark.createDataFrame(data, "k int, day date, n bigint, total_7 string")
    windows = (1, 5, 7, 30, 31)
    got = {(r["k"], r["day"]): r for r in trailing_totals(df, "k", "day", "n", windows).collect()}
    seen = 0
    for k, x in days.items():
        for no, d in enumerate(range(min(x), max(x) + 1), 1):
            r = got[k, D(2024, 1, 1) + dt.timedelta(days=d)]
            assert r["n"] == x.get(d, 0) and r["day_no"] == no
            for w in windows:
                total = sum(v for e, v in x.items() if d - w < e <= d)
                assert r[f"total_{w}"] == total and r[f"avg_{w}"] == pytest.approx(total / min(w, no))
            seen += 1
    assert seen == len(got)
    assert trailing_totals(df.limit(0), "k", "day", "n").count() == 0
    with pytest.raises(ValueError):
        trailing_totals(df, "k", "day", "n", (0,))


# spikes ----------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=12, max_size=80), st.integers(0, 79), st.floats(1.001, 100))
def test_far_values_are_always_flagged(values, at, times):
    x = np.array(values)
    centre, mad = np.median(x), np.median(np.abs(x - np.median(x)))
    x[at % len(x)] = centre + times * 10 * max(mad, 1e-3)
    flags, centre, mad = phase_space_spikes(x)
    assert flags[np.abs(x - centre) > 10 * mad].all()


def test_spikes_on_a_wave():
    x = np.sin(np.arange(200) / 5) + 0.01 * np.random.default_rng(0).normal(size=200)
    x[[50, 120, 121]] += [6, -5, 4]
    flags, _, _ = phase_space_spikes(x)
    assert {50, 120, 121} <= set(np.flatnonzero(flags)) and flags.sum() <= 5


def test_spikes_of_two_equal_readings():
    x = 10 * np.sin(np.arange(503) / 40)
    x[[125, 126]] = 6
    assert np.flatnonzero(phase_space_spikes(x)[0]).tolist() == [125, 126]


def test_spikes_are_fitted_until_none_is_outside():
    t = np.arange(400)
    x = 10 * np.sin(t / 40) + 3 * np.sin(t / 3) * (t % 200 < 60) * np.linspace(0, 1, 400)
    flags, _, _ = phase_space_spikes(x)
    kept = np.flatnonzero(~flags)
    centre = np.median(x[kept])
    again = outside(np.interp(t, kept, x[kept]), centre, np.median(np.abs(x[kept] - centre)), 1.25)
    assert len(kept) > 200 and not again[kept].any()


def test_moderate_spikes_are_found():
    """Recall and precision on planted spikes of 5 to 9.5 median absolute deviations, which a rule of 10 would miss."""
    r = np.random.default_rng(11)
    hit = planted = flagged = 0
    for n in (60, 200, 800):
        for _ in range(60):
            noise = r.normal(size=n)
            x = 4 + 0.5 * np.convolve(np.r_[noise[:2], noise], [0.6, 0.3, 0.1], "valid") + 0.2 * np.sin(np.arange(n) / 9)
            mad = np.median(np.abs(x - np.median(x)))
            at = np.arange(r.integers(5, 12), n - 5, 17) + r.integers(0, 4)
            x[at] = np.median(x) + r.choice([-1, 1], len(at)) * r.uniform(5, 9.5, len(at)) * mad
            found = set(np.flatnonzero(phase_space_spikes(x)[0]).tolist())
            hit, planted, flagged = hit + len(found & set(at.tolist())), planted + len(at), flagged + len(found)
    print(f"recall {hit / planted:.3f}, precision {hit / flagged:.3f}")
    assert hit / planted >= 0.9 and hit / flagged >= 0.9


def test_stuck_runs():
    assert stuck_runs(np.array([1, 1, 1, 2, 2, 3.0]), 3).tolist() == [True] * 3 + [False] * 3
    assert stuck_runs(np.array([]), 3).tolist() == []


def test_implausible(spark):
    day = lambda i: D(2025, 1, 1) + dt.timedelta(days=i)
    base = [("f", 1, day(i), 0.1 * (i % 7)) for i in range(20)]
    data = base + [("f", 1, day(30), 50.0), ("f", 1, day(31), float("nan")), ("f", 1, day(32), float("inf")), ("f", 1, day(33), -2.0), ("f", 1, day(34), None), ("f", None, day(1), 1.0), (None, 1, day(1), 1.0), ("f", 1, None, 1.0)]
    data += [("g", 2, day(i), 3.0 if i in range(4, 10) else i * 1.0) for i in range(14) if i != 6] + base[:4]  # a missing period does not break a run
    data += [("g", 3, day(i), 1.0) for i in range(11)]  # too few
    df = spark.createDataFrame(data, "field string, key bigint, period date, value double").withColumn("spike", F.lit("clash"))
    got = implausible(df, {"f": (-1.0, None), "g": (None, None)}).collect()
    assert {(r["key"], r["period"]) for r in got if r["impossible"]} == {(1, day(31)), (1, day(32)), (1, day(33))}
    assert {(r["key"], r["period"]) for r in got if r["stuck"]} == {(2, day(i)) for i in (4, 5, 7, 8, 9)} | ({(2, day(3))})
    assert (1, day(30)) in {(r["key"], r["period"]) for r in got if r["spike"]}
    assert len(got) == 24 + 13 + 11 and not any(r["spike"] or r["stuck"] for r in got if r["key"] == 3)
    assert implausible(df.limit(0), {}).count() == 0


# orphans ---------------------------------------------------------------------------------------


def test_orphans_against_sets(spark, rows):
    random.seed(5)
    at = lambda: random.choice([None, AT(2025, 1, random.randrange(1, 9), random.randrange(24))])
    parents = [(i, at()) for i in (random.randrange(60) for _ in range(50))] + [(None, AT(2025, 1, 1))]
    removed = [(i,) for i in range(40, 80, 3)] + [(None,)]
    refs = [(random.choice("ab"), random.choice([*range(90), None]), random.choice(["2025-01", "2025-02", "unknown", None]), at()) for _ in range(600)]
    frames = (
        spark.createDataFrame(refs, "src string, id bigint, period string, seen_at timestamp_ntz").withColumn("range", F.lit("clash")),
        spark.createDataFrame(parents, "id bigint, arrived_at timestamp_ntz"),
        spark.createDataFrame(removed, "id bigint"),
    )
    own, gone = {i for i, _ in parents if i is not None}, {i for (i,) in removed if i is not None}
    first = {i: min(t for j, t in parents if j == i and t) for i in own if any(t for j, t in parents if j == i)}
    expected = set()
    for s, i, p, t in refs:
        if i is None:
            continue
        if i not in own:
            expected.add((s, i, "deleted" if i in gone else "missing", p))
        elif s == "a" and t and i in first and first[i] > t:
            expected.add((s, i, "late", p))
    for ranges in (1, 7, None):
        got = [tuple(r) for r in find_orphans(*frames, late_sources=("a",), ranges=ranges).select("src", "id", "kind", "period").collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    assert any(k == "late" for _, _, k, _ in expected)
    no_parents = find_orphans(frames[0], frames[1].limit(0), frames[2].limit(0))
    assert {r["kind"] for r in no_parents.collect()} == {"missing"}
    assert find_orphans(frames[0].limit(0), *frames[1:], late_sources=("a",)).count() == 0


# packed ----------------------------------------------------------------------------------------


FIELDS = [
    ("a|b , c", ["a", "b", "c"]), ('"ci/cd"; x', ["ci/cd", "x"]), ('"say ""hello"""|y', ['say "hello"', "y"]), ("'\"smart\" home'|z", ['"smart" home', "z"]),
    ("['a','b c']", ["a", "b c"]), ("what's new", ["what", "s", "new"]), ('"what\'s new",c#', ["what's new", "c#"]), ("c++ f# .net node.js k8s_x-y", ["c++", "f#", ".net", "node.js", "k8s_x-y"]),
    ("", []), (None, []), (" ;|, ", []), ('""', []), ('" "', []), ("''", []), ('"open, x', ["open", "x"]), ('a"b', ["a", "b"]), ("x、y；z", ["x", "y", "z"]), ("A|a|A", ["A", "a", "A"]), ('"  pad  "', ["pad"]),
    ("'it''s'", ["it", "s"]), ('"a""b', ["a", "b"]),
]


@pytest.mark.parametrize("protect", [False, True])
def test_segmenter_cases(protect):
    segment = Segmenter(['"ci/cd"', '"data, big"'], protect)
    for text, expected in FIELDS:
        assert segment(text) == expected, text


def plain(text):
    return [v for m in regex.finditer(f"{QUOTED}|{BARE}", text) if (v := unquote(m.group()))]


AWKWARD = st.text(alphabet="ab\"' ,|+é\n", max_size=30)


@settings(max_examples=500, deadline=None)
@given(AWKWARD)
def test_segmenter_without_dictionary_is_the_rule(text):
    assert Segmenter([])(text) == plain(text)


@settings(max_examples=1000, deadline=None)
@given(AWKWARD, st.lists(st.text(alphabet="ab ,", min_size=1, max_size=4), max_size=4))
def test_segmenter_departs_from_the_rule_only_for_a_known_value(text, bodies):
    """The dictionary decides just where the reading from left to right cuts a known value apart."""
    segment = Segmenter([f'"{b}"' for b in bodies])
    spans = [m.span() for m in regex.finditer(f"{QUOTED}|{BARE}", text)]
    cut = any(not any(s <= a and b <= e for s, e in spans) for a, b in segment.known(text))
    assert cut or segment(text) == plain(text)


@pytest.mark.parametrize(
    "text,rule,guided",
    [
        ("don't stop, \"it's on\"", ["don", 't stop, "it', "s", "on"], ["don", "t", "stop", "it's on"]),  # an apostrophe pairs with one in quotes
        ('"open, x | "ci/cd"', ["open, x |", "ci", "cd"], ["open", "x", "ci/cd"]),  # a closing quote is missing
        ("5' x, 'r & d'", ["5", "x,", "r", "d"], ["5", "x", "r & d"]),
        ("\"the 'ci/cd' way\"", ["the 'ci/cd' way"], ["the 'ci/cd' way"]),  # within quotes everything belongs to the value
    ],
)
def test_segmenter_keeps_known_values_whole(text, rule, guided):
    assert Segmenter([])(text) == plain(text) == rule
    assert Segmenter(['"it\'s on"', '"ci/cd"', "'r & d'", "'ci/cd'"])(text) == guided


def test_segmenter_protects_known_values():
    segment = Segmenter(['"ci/cd"', '"state of the art"'], protect_bare=True)
    assert segment("ci/cd|art") == ["ci/cd", "art"]
    assert segment("go state of the art x") == ["go", "state of the art", "x"]
    assert segment("xci/cdx") == ["xci", "cdx"]
    assert Segmenter(['"a b"', '"b c d"'], protect_bare=True)("a b c d") == ["a", "b c d"]  # the longer one stays whole


def test_split_packed(spark):
    data = [(i, t, "clash") for i, (t, _) in enumerate(FIELDS)] + [(99, "|".join(["long", '"q,q"'] * 20_000), "")]
    df = spark.createDataFrame(data, "i int, topics string, __kinds string")
    forms = known_forms(df, "topics")
    assert {'"q,q"', '"ci/cd"', '"what\'s new"', "'b c'"} <= {r["form"] for r in forms.collect()} and not {'"  pad  "', "'a'"} & {r["form"] for r in forms.collect()}
    got = split_packed(df, ["i"], "topics", forms).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["i"], r["pos"])):
        by.setdefault(r["i"], []).append(r["value"])
        assert r["pos"] == len(by[r["i"]])
    assert {i: v for i, v in by.items() if i < 99} == {i: v for i, (_, v) in enumerate(FIELDS) if v}
    assert len(by[99]) == 40_000
    assert split_packed(df.limit(0), ["i"], "topics", known_forms(df.limit(0), "topics")).count() == 0
    with pytest.raises(ValueError):
        split_packed(df.withColumnRenamed("i", "pos"), ["pos"], "topics")


@pytest.mark.parametrize("protect", [False, True])
def test_parts_of_the_dictionary_do_not_matter(spark, rows, protect):
    data = [(1, "'a, b'|'c/d'|'e f'"), (2, "a, b c/d e f"), (3, "x's 'a, b's"), (4, None), (5, "don't, 'e f', isn't")]
    df = spark.createDataFrame(data, "i int, t string")
    one, many = (rows(split_packed(df, ["i"], "t", known_forms(df, "t"), protect, at_once)) for at_once in (10_000, 4))
    assert one == many and ((2, 1, "a, b") in one) == protect and (5, 3, "e f") in one


def test_hidden_quotes_are_found_again():
    """Recall and precision of protection: quotes dropped around values that other fields quote."""
    r = random.Random(7)
    values = ["ci/cd", "state of the art", "r & d", "map | reduce", "data, big", "on-call; rota", "home automation", "a|b testing", "image (raster)"]
    words = ["go", "rust", "web", "c++", "api", "cli", "sql", "linux", *(w for v in values for w in regex.findall(BARE, v))]  # also the values' own parts
    segment = Segmenter([f'"{v}"' for v in values], protect_bare=True)
    hit = wrong = missed = 0
    for _ in range(4000):
        fields = [r.choice(values) if r.random() < 0.3 else r.choice(words) for _ in range(r.randrange(1, 9))]
        expected, got = [v for v in fields if v in values], [v for v in segment(r.choice([", ", "|", " | ", "; ", "/", " ", " & "]).join(fields)) if v in values]
        both = sum(min(expected.count(v), got.count(v)) for v in values)
        hit, wrong, missed = hit + both, wrong + len(got) - both, missed + len(expected) - both
    print(f"recall {hit / (hit + missed):.4f}, precision {hit / (hit + wrong):.4f}")
    assert hit / (hit + missed) >= 0.9 and hit / (hit + wrong) >= 0.9


# heavy keys ------------------------------------------------------------------------------------


@pytest.mark.parametrize("most_keys", [3, 1_000_000])
def test_key_totals(spark, most_keys):
    random.seed(2)
    data = [(7 if i % 3 else random.choice([None, *range(40)]), random.choice(["", None, "x", "é" * 500]), random.choice([None, AT(2025, 1, 1 + i % 28)])) for i in range(900)]
    df = spark.createDataFrame(data, "id bigint, name string, at timestamp_ntz").withColumn("n_rows", F.lit("clash")).repartition(5)
    got = {(r["key_field"], r["key_value"]): tuple(r)[2:] for r in key_totals(df, ["id", "name"], "at", blocks=8, most_keys=most_keys).collect()}
    expected = {}
    for field, at in (("id", 0), ("name", 1)):
        for r in data:
            key = (field, None if r[at] is None else str(r[at]))
            expected.setdefault(key, []).append(r[2])
    assert got == {k: (len(v), min(filter(None, v), default=None), max(filter(None, v), default=None)) for k, v in expected.items()}
    assert key_totals(df.limit(0), ["id"]).count() == 0


# joins -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 4, 1024])
def test_spread_join(spark, rows, parts):
    data = [(1, i) for i in range(50)] + [(2, 0), (2, 0), (5, 3)] + [(None, i) for i in range(9)]
    big = spark.createDataFrame(data, "k int, i int")
    small = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "k int, v string")
    weights = big.where("k is not null").groupBy("k").count()
    for how in ("left", "inner"):
        got = spread_join(big, small, weights, "k", ["i"], how, parts)
        assert rows(got.select("k", "i", "v")) == rows(big.join(small, "k", how).select("k", "i", "v"))
    assert spread_join(big.limit(0), small, weights.limit(0), "k", ["i"]).count() == 0


def test_spread_join_copies_hot_keys_only(spark):
    big = spark.range(4000).selectExpr("if(id % 3 = 0, 0, id) AS k", "id AS i")
    weights = big.groupBy("k").count()
    plan = spread_join(big, weights.select("k", F.lit("x").alias("v")), weights, "k", ["i"], parts=64)
    assert plan.where("v is null").count() == 0 and plan.count() == 4000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sides = spread_join(big, weights, weights, "k", ["i"], parts=64)
        assert sides.count() == 4000
        hot = weights.where(F.col("count") * 64 >= 4000)
        assert hot.count() == 1 and hot.selectExpr("ceil(count * 64 / 4000) AS n").first()["n"] == 22
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_halo_is_the_rows_before(spark):
    random.seed(4)
    data = [(k, t, t // 10) for k in "ab" for t in random.sample(range(200), 40)]
    df = spark.createDataFrame(data, "k string, t int, c int")
    got = with_halo(df, "k", "c", ["t"], 3).collect()
    for k in "ab":
        own = sorted(t for j, t, _ in data if j == k)
        for c in {c for j, _, c in data if j == k}:
            first = min(t for t in own if t // 10 == c)
            assert sorted(r["t"] for r in got if r["k"] == k and r["c"] == c and r["__halo"]) == own[max(0, own.index(first) - 3) : own.index(first)]


# storage ---------------------------------------------------------------------------------------


def test_storage_needs_a_shared_folder_off_local_masters(spark):
    conf = SimpleNamespace(get=lambda key, default=None: default)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(ValueError):
        session.shared_dir(cluster)
    assert session.shared_dir(spark)


def test_scratch_leaves_nothing(spark):
    folder = session.shared_dir(spark).removeprefix("file://")
    kept = session.stored(spark.range(3))
    before = set(os.listdir(folder))
    with session.scratch():
        assert session.stored(spark.range(5)).count() == 5 and len(os.listdir(folder)) > len(before)
    assert set(os.listdir(folder)) == before and kept.count() == 3
    session.drop_stored()
    assert not [f for f in os.listdir(folder) if f.startswith("growthlens-")]


# workers ---------------------------------------------------------------------------------------


def test_workers_find_the_package(tmp_path):
    """The driver may import the package by a path that its workers do not have."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "run.py"
    script.write_text(
        f"""import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from growthlens.operators.heavy_keys import key_totals
from growthlens.operators.packed import split_packed
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
df = spark.createDataFrame([(1, "a|b"), (1, "c")], "i int, t string")
print("rows", key_totals(df, ["i"]).count(), split_packed(df, ["i"], "t", df.selectExpr("'a' AS form")).count())
"""
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1 3" in done.stdout, done.stderr[-2000:]
