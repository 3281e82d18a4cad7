import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from growthlens.llm import mixing
from growthlens.llm.mixing import dealt, dealt_places, grain, mix_report, mix_sources, read_targets

TARGETS = "source string, target_share double, max_repeats int"


def split_tree(quotas, shards, seed):
    """Blocks of each source (columns) in each shard (rows)."""
    return np.array([n for _, _, n in sorted(dealt(quotas, shards, seed), key=lambda x: x[0])])


def test_tree_is_exact_and_fair():
    quotas = np.array([1000, 37, 0, 500])
    whole = split_tree(quotas, 7, 1)
    assert (whole.sum(axis=0) == quotas).all() and whole.min() >= 0
    assert np.ptp(whole.sum(axis=1)) <= 3  # shards of equal size
    assert (whole == split_tree(quotas, 7, 1)).all() and (whole != split_tree(quotas, 7, 2)).any()
    assert [(i, a.tolist(), n.tolist()) for i, a, n in dealt(quotas, 7, 1, 2, 5)] == [(i, a.tolist(), n.tolist()) for i, a, n in dealt(quotas, 7, 1) if 2 <= i < 5]  # any part by itself
    starts = {i: a for i, a, _ in dealt(quotas, 7, 1)}
    assert all((starts[i] == whole[:i].sum(axis=0)).all() for i in range(7))
    means = np.mean([split_tree(quotas, 8, s)[3] for s in range(300)], axis=0)
    assert means == pytest.approx(quotas / 8, rel=0.1)


@pytest.fixture
def corpus(spark):
    r = random.Random(3)
    sources = ["Big", " big ", "small-one", "SMALL_ONE", "tiny", "other", None]
    data = [(i, None if i % 50 == 0 else "word " * r.randrange(40), sources[0] if i % 3 == 0 else r.choice(sources[:6] if i % 40 else sources)) for i in range(900)]
    docs = spark.createDataFrame(data, "doc bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.25, 1), ("Small-One", 0.5, 2), ("tiny", 0.2, None), ("absent", 0.05, 3), (None, 0.1, 1)], TARGETS)
    return data, docs, targets


def test_mixture(corpus):
    data, docs, targets = corpus
    plain = lambda s: s and s.strip().lower().replace("-", "_")
    rows = mix_sources(docs, targets, "doc", "text", blocks=64, shards=5).collect()
    report = {r["source"]: r for r in mix_report(docs, targets, "doc", "text", blocks=64, shards=5).collect()}
    size, owner = {i: len((t or "").split()) + bool(t) for i, t, _ in data}, {i: plain(s) for i, _, s in data}
    tokens = defaultdict(int)
    for r in rows:
        assert owner[r["doc"]] == r["source"] and (size[r["doc"]] == r["n_tokens"])
        tokens[r["source"]] += r["n_tokens"]
    assert set(tokens) <= {"big", "small_one", "tiny"}
    repeats = Counter(r["doc"] for r in rows)
    assert all(n <= {"big": 1, "small_one": 2, "tiny": 1}[owner[d]] for d, n in repeats.items())
    assert len({(r["doc"], r["copy"]) for r in rows}) == len(rows)
    supply = Counter()
    for i, s in owner.items():
        supply[s] += size[i]
    total = supply["big"] + supply["small_one"] + supply["tiny"]
    for s, share, most in (("big", 0.25, 1), ("small_one", 0.5, 2), ("tiny", 0.2, 1), ("absent", 0.05, 3)):
        r = report[s]
        assert r["tokens"] == supply[s] and r["drawn_tokens"] == tokens[s] and r["short"] == (supply[s] * most < share * total)
        assert tokens[s] == pytest.approx(min(share * total, supply[s] * most), abs=supply[s] / 40 + 1)
        assert r["reached_share"] == pytest.approx(tokens[s] / sum(tokens.values()))
    for shard in range(5):
        own = sorted(r["pos"] for r in rows if r["shard"] == shard)
        assert own == list(range(1, len(own) + 1))
    again = mix_sources(docs, targets, "doc", "text", blocks=64, shards=5).collect()
    assert sorted(again) == sorted(rows)


def test_edges(spark, corpus):
    _, docs, targets = corpus
    assert mix_sources(docs.limit(0), targets, "doc", "text", blocks=8, shards=2).count() == 0
    assert mix_sources(docs, targets.limit(0), "doc", "text", blocks=8, shards=2).count() == 0
    assert mix_report(docs.limit(0), targets, "doc", "text", blocks=8, shards=2).where("short").count() == 0
    with pytest.raises(ValueError):
        read_targets(spark.createDataFrame([("a-b", 0.5, 1), (" A_B", 0.5, 1)], TARGETS))
    assert dealt_places(spark, np.zeros(2, np.int64), 3, 0).count() == 0


def test_every_drawn_block_has_one_place(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARDS_A_TASK", 3)
    places = [tuple(r) for r in dealt_places(spark, np.array([50, 0, 7]), 20, 5).select("k", "p").collect()]
    assert sorted(places) == [(0, p) for p in range(50)] + [(2, p) for p in range(7)]


def test_grain_does_not_depend_on_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 10, raising=False)
    monkeypatch.setattr(mixing, "SHARD_BYTES", 100, raising=False)
    docs = spark.range(2000).selectExpr("id AS doc", "'web' AS source", "repeat('word ', 50) AS text")
    found = set()
    for codec, files in (("none", 1), ("zstd", 1), ("zstd", 7)):
        docs.repartition(files).write.mode("overwrite").option("compression", codec).parquet(str(tmp_path / f"{codec}{files}"))
        found.add(grain(spark.read.parquet(str(tmp_path / f"{codec}{files}")), 2, None, None))
    assert found == {(1600, 200)}
