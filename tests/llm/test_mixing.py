from collections import Counter

import numpy as np
import pytest

from pagemill.llm import mixing

DOCS = "doc_id long, text string, source string, tokens long, block long, bucket int"
TARGETS = "source string, target_share double, max_repeats int, tokens long"


def documents(spark):
    rows = [(i, f"word{i} " * (3 + i % 40), "big" if i % 3 else "mid", 1, 2, 3) for i in range(300)]
    rows += [(1000 + i, "tiny text here " * 5, "small", 1, 2, 3) for i in range(4)]
    rows += [(2000, None, "big", 1, 2, 3), (2001, "", "big", 1, 2, 3), (2002, "x y z", None, 1, 2, 3), (2003, "not wanted", "other", 1, 2, 3)]
    return spark.createDataFrame(rows, DOCS)


def targets(spark):
    return spark.createDataFrame([("big", 0.3, 2, 0), ("mid", 0.5, 3, 0), ("small", 0.1, 2, 0), ("absent", 0.1, 4, 0)], TARGETS)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation_visits_every_place(n):
    i = np.arange(n)
    assert sorted(mixing.permute(i, n, np.full(n, 12345))) == list(range(n))


def test_quotas_follow_targets_and_caps():
    q = mixing.quotas({"a": 1000, "b": 1000, "c": 10}, {"a": (0.5, 2), "b": (0.3, 2), "c": (0.2, 3), "d": (0.1, 2)}, 10, 100)
    assert q["c"] == (1, 3) and q["d"] == (0, 0) and sum(x[1] for x in q.values()) == 100
    assert abs(q["a"][1] / q["b"][1] - 5 / 3) < 0.05


def test_draws_give_the_totals():
    quota = {"a": (10, 37), "b": (5, 12), "c": (1, 0)}
    rows = mixing.draw(quota, 10, 3)
    got = Counter()
    for _, s, _, n, _, _ in rows:
        got[s] += n
    assert got == {"a": 37, "b": 12} and max(r[5] for r in rows) == 10


def test_mixture_is_whole(spark):
    d, t = documents(spark), targets(spark)
    mix = mixing.mixture(d, t, length=16, slots=200, shard_slots=50).toPandas()
    slots = mix.groupby(["shard", "slot"])
    assert len(slots) == 200 and slots.block.nunique().max() == 1
    uses = mix.groupby(["source", "block"]).apply(lambda g: len(set(zip(g["shard"], g["slot"]))), include_groups=False)
    cap = {"big": 2, "mid": 3, "small": 2}
    assert all(n <= cap[s] for (s, _), n in uses.items())
    counts = {r.doc_id: r.tokens for r in mixing.token_counts(d, t).collect()}
    parts = mixing.segments(mixing.offsets(mixing.token_counts(d, t), bucket_docs=40), 16).toPandas()
    assert (parts.to_token - parts.from_token).groupby(parts.doc_id).sum().to_dict() == counts
    sizes = (parts.to_token - parts.from_token).groupby([parts.source, parts.block]).sum()
    assert sizes.max() == 16 and (sizes < 16).sum() <= 3


def test_report(spark):
    rep = {r.source: r for r in mixing.shares(documents(spark), targets(spark), length=16, slots=200, shard_slots=64).collect()}
    assert rep["absent"].actual_share == 0 and rep["small"].most_used <= 2
    assert abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9
    assert abs(rep["mid"].actual_share / rep["big"].actual_share - 5 / 3) < 0.1


def test_empty_tables(spark):
    d, t = spark.createDataFrame([], DOCS), targets(spark)
    assert mixing.mixture(d, t).count() == 0
    assert mixing.shares(d, t).count() == 4
    assert mixing.mixture(documents(spark), spark.createDataFrame([], TARGETS)).count() == 0


def test_draws_of_a_hundred_billion_slots():
    quota = {"a": (10**11, 6 * 10**10), "b": (10**11, 4 * 10**10), "rare": (10, 1000)}
    width = 10**7
    n = mixing.shards_of(quota, width)
    assert n == 10_001
    for shard in (0, n // 2, n - 2):
        got = {s: k for _, s, _, k, _, _ in mixing.shard_counts(quota, width, 5, shard)}
        assert sum(got.values()) == width and abs(got["a"] / width - 0.6) < 0.001 and got.get("rare", 0) < 20
    last = mixing.shard_counts(quota, width, 5, n - 1)
    assert sum(r[3] for r in last) == 1000 and all(r[2] + r[3] == quota[r[1]][1] for r in last)


def test_shards_are_consistent_with_each_other():
    quota = {"a": (40, 3000), "b": (50, 1500), "c": (9, 17)}
    used = Counter()
    for shard in range(mixing.shards_of(quota, 64)):
        rows = mixing.shard_counts(quota, 64, 2, shard)
        for _, s, first, k, _, _ in rows:
            assert first == used[s]
            used[s] += k
        assert sum(r[3] for r in rows) == rows[0][5] == min(64, 4517 - 64 * shard)
    assert used == {"a": 3000, "b": 1500, "c": 17}


def test_split_beyond_a_billion_has_the_right_spread():
    r = np.random.default_rng(1)
    x = np.array([mixing._split(3 * 10**9, 2 * 10**9, 10**9, r) for _ in range(2000)], dtype=float)
    assert abs(x.mean() - 6e8) < 4e3 and abs(x.std() / np.sqrt(1e9 * 0.6 * 0.4 * 0.8) - 1) < 0.1


def test_missing_tokenizer_is_an_error(spark):
    with pytest.raises(FileNotFoundError):
        mixing.mixture(documents(spark), targets(spark), path="/nowhere/ranks.tiktoken")


def test_checked_counts_nothing(spark):
    rows = mixing.checked(documents(spark), targets(spark), length=16, slots=200, shard_slots=50).collect()
    assert {r.source for r in rows} == {"big", "mid", "small", "absent"}
    assert all(r.uses_over_cap == r.foreign_parts == r.broken_parts == r.uneven_slots == 0 for r in rows)
