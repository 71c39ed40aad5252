from collections import Counter

import numpy as np
import pytest

from tributary.llm import mixing
from tributary.llm.mixing import leaf, mix, quotas


def test_quotas():
    assert quotas({"a": 100, "b": 50, "c": 10}, {"a": 1, "b": 1}) == {"a": 50, "b": 50, "c": 0}
    assert quotas({"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1, "c": 1}, total=10) == {"a": 4, "b": 3, "c": 3}
    assert sum(quotas({"a": 1000, "b": 10}).values()) == 10 + 100
    assert quotas({"a": 5}, {}) == {"a": 0} and quotas({}) == {}
    for bad in ({"a": -1.0}, {"a": float("nan")}):
        with pytest.raises(ValueError):
            quotas({"a": 1}, bad)
    with pytest.raises(ValueError):
        quotas({"a": 1, "b": 9}, {"a": 1, "b": 1}, total=4)


def test_a_rare_source_does_not_bound_the_total(make):
    counts = {"hot": 5_000_000, **{f"s{i}": 250_000 for i in range(19)}, "": 1}
    assert sum(quotas(counts).values()) < 0.002 * sum(counts.values())
    assert quotas(counts, fill=True) == counts
    got = quotas(counts, total=6_000_001, fill=True)
    assert sum(got.values()) == 6_000_001 and got[""] == 1 and got["s0"] == 250_000 and got["hot"] == 1_250_000
    assert quotas({"a": 9, "b": 1}, {"a": 1, "b": 1}, total=4, fill=True) == {"a": 3, "b": 1}
    assert quotas({"a": 9, "b": 9}, {"a": 1}, fill=True) == {"a": 9, "b": 0} and quotas({}, fill=True) == {}
    df = make(*[(i, f"text {i}", "many" if i else None) for i in range(50)])
    assert mix(df).count() < 10 and mix(df, fill=True).count() == 50
    assert Counter(r.source for r in mix(df, total=20, fill=True).collect()) == {"many": 19, None: 1}


def test_leaves_are_an_exact_deal():
    blocks = np.array([40, 7, 0, 13])
    for shards in (1, 2, 7, 16):
        deal = np.stack([leaf(blocks, shards, s, 5) for s in range(shards)])
        assert (deal.sum(0) == blocks).all() and (deal >= 0).all()
        assert deal.sum(1).max() - deal.sum(1).min() <= 1 + np.log2(shards)


def test_leaves_are_hypergeometric():
    blocks, shards = np.array([30, 10]), 4
    drawn = np.array([leaf(blocks, shards, 1, seed)[0] for seed in range(3000)])
    # 10 of 40 blocks, of which 30 are of the first kind.
    mean, var = 10 * 30 / 40, 10 * (30 / 40) * (10 / 40) * (30 / 39)
    assert abs(drawn.mean() - mean) < 0.1 and abs(drawn.var() - var) < 0.15


def test_mix_by_force(make, monkeypatch):
    """Ranks, blocks, shards and order worked out again from the hashes alone."""
    rows = [(i, f"text {i}", f"s{min(2, i % 5)}") for i in range(600)]
    df = make(*rows)
    plain = df.withColumn("h", mixing.F.xxhash64(mixing.F.lit(mixing.SEED), "doc_id", "text")).collect()
    want = quotas(Counter(r.source for r in plain))
    names, block, size = sorted(want), 4, 50
    shards = -(-sum(want.values()) // size)
    blocks = np.array([-(-want[s] // block) for s in names])
    expected = {}
    dealt = np.stack([leaf(blocks, shards, k, mixing.SEED) for k in range(shards)])
    for j, s in enumerate(names):
        ranked = [r.doc_id for r in sorted((r for r in plain if r.source == s), key=lambda r: r.h)]
        at = 0
        for k in range(shards):
            n = min(int(dealt[k, j]) * block, want[s] - at)
            expected |= dict.fromkeys(ranked[at : at + n], k)
            at += n
    for rank_rows in (200_000, 20):
        monkeypatch.setattr(mixing, "RANK_ROWS", rank_rows)
        out = mix(df, shard_rows=size, block=block).collect()
        got = {r.doc_id: r["_shard"] for r in out}
        assert got == expected and len(out) == sum(want.values())
        assert Counter(r.source for r in out) == Counter({s: n for s, n in want.items() if n})
        for k in range(shards):
            assert sorted(r["_position"] for r in out if r["_shard"] == k) == list(range(sum(v == k for v in expected.values())))


def test_awkward(awkward, make):
    out = mix(awkward, weights={"src0": 1, "src1": 1, "": 1})
    assert out.columns == [*awkward.columns, "_shard", "_position"]
    counts = Counter(r.source for r in out.collect())
    assert counts == {None: 1, "src0": 1, "src1": 1}
    assert mix(awkward.limit(0)).count() == 0 and mix(awkward, weights={}).count() == 0
    same = make(*[(1, "same")] * 10)
    assert mix(same).count() == 10


def test_quotas_hold_where_rows_repeat(make, monkeypatch):
    """By force: every source gives its quota, and no row is given more often than it is there."""
    for copies in (2, 10, 50, 200):
        rows = [(i, f"text {i}", "x") for i in range(100)] + [(7, "text 7", "x")] * copies + [(1000 + i, f"other {i % 9}", "y") for i in range(90)] + [(5000, "other", "y")] * copies
        have = Counter(rows)
        for rank_rows in (200_000, 40) if copies == 50 else (200_000,):
            monkeypatch.setattr(mixing, "RANK_ROWS", rank_rows)
            out = mix(make(*rows), weights={"x": 1, "y": 1}, total=60, shard_rows=8, block=4).collect()
            assert Counter(r.source for r in out) == {"x": 30, "y": 30}, copies
            assert all(n <= have[row] for row, n in Counter((r.doc_id, r.text, r.source) for r in out).items())
            for k in {r["_shard"] for r in out}:
                own = sorted(r["_position"] for r in out if r["_shard"] == k)
                assert own == list(range(len(own)))
    everything = mix(make(*rows), total=len(rows), fill=True, shard_rows=8, block=4).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in everything) == have
