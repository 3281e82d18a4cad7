import math
import os
import random
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from growthlens.llm import queries
from growthlens.llm.cooccurrence import together
from growthlens.llm.queries import p4_pairs

SMALL = "/root/testdata/sf0.001"


def brute(data, min_count, min_jaccard, min_lift):
    baskets = defaultdict(set)
    for u, i in data:
        if u is not None and i is not None:
            baskets[u].add(i)
    size = Counter(i for b in baskets.values() for i in b)
    both = Counter(p for b in baskets.values() for p in combinations(sorted(b), 2))
    n, out = len(baskets), {}
    for (x, y), k in both.items():
        a, b = size[x], size[y]
        if k >= min_count and k / (a + b - k) >= min_jaccard and k * n >= min_lift * a * b:
            out[x, y] = (k, a, b, n)
    return out


def baskets_of(seed, users, items, large, groups=True):
    """Small baskets by taste, some large ones, repeats and nulls; ids beyond 32 bits."""
    r = random.Random(seed)
    ids = [r.randrange(1 << 40) for _ in range(items)]
    data = []
    for u in range(users):
        taste = r.randrange(0, items, 5) if groups else 0
        data += [(u, ids[(taste + r.randrange(6)) % items if r.random() < 0.7 else r.randrange(items)]) for _ in range(r.randrange(1, 7))]
    for u in range(users, users + large):
        data += [(u, i) for i in r.sample(ids, items * 2 // 3)]
    return data + data[: users // 3] + [(None, ids[0]), (1, None), (None, None)]


@pytest.mark.parametrize(
    "seed,users,items,large,max_basket,limits",
    [
        (1, 200, 30, 0, 512, (5, 0.2, 0.0)),
        (2, 200, 30, 0, 512, (5, 0.2, 3.0)),
        (3, 60, 40, 12, 8, (5, 0.2, 0.0)),  # many pairs only through large baskets
        (4, 0, 25, 14, 8, (5, 0.3, 0.0)),  # nothing but large baskets
        (5, 80, 30, 9, 3, (3, 0.1, 1.0)),
        (6, 50, 20, 6, 5, (2, 0.0, 0.0)),  # no limit on sizes
        (7, 40, 20, 6, 6, (1, 1.0, 0.0)),
    ],
)
def test_against_all_pairs(spark, seed, users, items, large, max_basket, limits):
    data = baskets_of(seed, users, items, large)
    df = spark.createDataFrame(data, "user bigint, item bigint").withColumn("k", F.lit("clash"))
    got = together(df, "user", "item", *limits, max_basket=max_basket).collect()
    expected = brute(data, *limits)
    assert len(got) == len({(r["item_a"], r["item_b"]) for r in got})
    assert {(r["item_a"], r["item_b"]): (r["k"], r["a"], r["b"], r["n"]) for r in got} == expected
    for r in got:
        k, a, b, n = r["k"], r["a"], r["b"], r["n"]
        term = lambda o, e: o * math.log(o / e) if o else 0.0
        g2 = 2 * (term(k, a * b / n) + term(a - k, a * (n - b) / n) + term(b - k, (n - a) * b / n) + term(n - a - b + k, (n - a) * (n - b) / n))
        assert r["llr"] == pytest.approx(g2, abs=1e-6) and r["lift"] == pytest.approx(k * n / a / b)
    if seed < 6:
        assert expected


def test_significance(spark):
    data = baskets_of(9, 150, 20, 3)
    df = spark.createDataFrame(data, "user bigint, item bigint")
    every = together(df, "user", "item", 1, 0.0).collect()
    found = {(r["item_a"], r["item_b"]) for r in together(df, "user", "item", 1, 0.0, min_llr=10.0).collect()}
    assert found == {(r["item_a"], r["item_b"]) for r in every if r["llr"] >= 10 and r["lift"] > 1} and 0 < len(found) < len(every)


@pytest.mark.parametrize("max_basket", [1, 8, 512])
def test_size_of_blocks_does_not_matter(spark, max_basket):
    if not os.path.exists(SMALL):
        pytest.skip("no test tables here")
    df = spark.read.parquet(f"{SMALL}/user_repo_interactions.parquet")
    data = [(r["user_id"], r["repo_id"]) for r in df.collect()]
    got = together(df, "user_id", "repo_id", 2, 0.1, max_basket=max_basket).collect()
    assert {(r["item_a"], r["item_b"]): (r["k"], r["a"], r["b"], r["n"]) for r in got} == brute(data, 2, 0.1, 0.0)


@pytest.mark.parametrize("name", ["p4_found", "p4_pairs", "p4_significant"])
def test_query_equals_sql(spark, name):
    if not os.path.exists(SMALL):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW user_repo_interactions AS SELECT * FROM read_parquet('{SMALL}/user_repo_interactions.parquet')")
    got, expected = queries.queries()[name](spark, SMALL).toArrow(), c.sql(queries.oracle_sql()[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(expected.column_names)
    values = lambda t: sorted(zip(*(t.column(x).to_pylist() for x in columns)))
    assert values(got) == values(expected)


def test_empty_and_refused(spark):
    df = spark.createDataFrame([], "u string, i int")
    assert together(df, "u", "i").count() == 0
    assert together(spark.createDataFrame([("a", 1), ("b", None)], "u string, i int"), "u", "i", 1).count() == 0
    with pytest.raises(ValueError):
        together(df, "u", "i", min_jaccard=2)


def test_p4_pairs_has_every_pair(spark, tmp_path):
    data = baskets_of(8, 120, 30, 2) + [(u, 1) for u in range(90)] + [(u, 2) for u in range(6)]  # a popular item and a niche within it
    spark.createDataFrame(data, "user_id bigint, repo_id bigint").write.parquet(str(tmp_path / "user_repo_interactions.parquet"))
    got = {(r["repo_a"], r["repo_b"]): (r["k"], r["a"], r["b"], r["n"]) for r in p4_pairs(spark, str(tmp_path)).collect()}
    assert got == brute(data, 1, 0.0, 0.0)
    assert got[1, 2][0] == 6 and min(k for k, *_ in got.values()) == 1
