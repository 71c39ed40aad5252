import random
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pyarrow as pa

from tributary.llm import near
from tributary.llm.components import components
from tributary.llm.shingles import shingles


def roots(n, edges):
    to = list(range(n))

    def top(x):
        while to[x] != x:
            x = to[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        to[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def by_force(rows, threshold=near.SEARCH.threshold):
    """(doc_id, duplicate_of) of all pairs of documents compared exactly."""
    rows = [(i, t) for i, t in rows if i is not None and t is not None]
    ids = sorted({i for i, _ in rows})
    place = {i: k for k, i in enumerate(ids)}
    sets = near._sets(pa.array([t for _, t in rows], pa.string()), near.SEARCH)
    having, edges, texts = defaultdict(list), [], {}
    for k, (s, (i, t)) in enumerate(zip(sets, rows, strict=True)):
        for h in s.tolist():
            having[h].append(k)
        edges.append((place[i], place[rows[texts.setdefault(t, k)][0]]))
    shared = Counter((a, b) for v in having.values() for n, b in enumerate(v) for a in v[:n])
    edges += [(place[rows[a][0]], place[rows[b][0]]) for (a, b), c in shared.items() if c / (len(sets[a]) + len(sets[b]) - c) >= threshold]
    top = roots(len(ids), edges)
    return {(ids[k], ids[t]) for k, t in enumerate(top) if k != t}


def words(rng, n):
    return [f"{rng.choice('bcdfghklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfghklmnprst')}{rng.randint(0, 40)}" for _ in range(n)]


def copies(seed=4):
    """Texts with copies at many similarities, shared passages, and a large group."""
    rng, out = random.Random(seed), []
    passage = words(rng, 80)
    for g in range(60):
        base = words(rng, rng.randint(30, 200))
        for _ in range(rng.choice([1, 1, 2, 3]) if g else 120):
            text = list(base)
            for _ in range(int(len(text) * rng.choice([0, 0, 0.01, 0.03, 0.1, 0.4]))):
                text[rng.randrange(len(text))] = words(rng, 1)[0]
            out.append(" ".join(text + passage * (g % 3 == 0)))
    rng.shuffle(out)
    return list(enumerate(out))


def test_shingles():
    texts = ["One two three four", "a", "", "?!", "x  y", "é É z", "one TWO, three"]
    hashes, counts = shingles(*near.text_bytes(pa.array(texts))[:2], 3)
    assert counts.tolist() == [2, 1, 0, 0, 1, 1, 1]
    assert hashes[0] == hashes[-1] and len(set(hashes.tolist())) == 5


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000, np.uint64)
    for shared in (0.2, 0.5, 0.8):
        diffs = []
        for _ in range(40):
            x = rng.choice(pool, 600, False)
            cut = int(600 * shared / (1 + shared) * 2 / 2)
            a, b = x[: 300 + cut // 2], x[300 - cut // 2 :]
            both = near.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
            diffs.append((both[0] == both[1]).mean() - near.jaccard(np.sort(a), np.sort(b)))
        assert abs(np.mean(diffs)) < 0.02


def test_pruning_bounds():
    for n, m in near.least_matches():
        tail = lambda k: sum(comb(n + 1, j) * 0.55**j * 0.45 ** (n + 1 - j) for j in range(k + 1))  # noqa: E731, B023
        assert tail(m) >= near.SEARCH.miss and (m == 0 or tail(m - 1) < near.SEARCH.miss)
    rng = np.random.default_rng(1)
    left = rng.integers(0, 1 << 16, (4000, 128)).astype(np.uint16)
    right = np.where(rng.random((4000, 128)) < 0.55, left, left ^ 1)
    assert near.survivors(left, right).mean() > 0.98
    right = np.where(rng.random((4000, 128)) < 0.2, left, left ^ 1)
    assert near.survivors(left, right).mean() < 0.01


def test_against_brute_force(make, documents):
    for rows in (copies(), [(r.doc_id, r.text) for r in documents.collect()]):
        got = {(r.doc_id, r.duplicate_of) for r in near.pairs(make(*rows)).collect()}
        want = by_force(rows)
        assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_every_member_of_a_bucket_is_compared(make):
    """Pairs that miss the bucket's least member are found across its groups."""
    rng = random.Random(8)
    base = words(rng, 300)
    change = lambda t, where: [w if i not in where else "new" + str(i) for i, w in enumerate(t)]
    a = change(base, set(range(0, 90)))
    b, c = change(base, set(range(150, 210))), change(base, set(range(150, 212)))
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))]
    assert {(r.doc_id, r.duplicate_of) for r in near.pairs(make(*rows)).collect()} == by_force(rows)


def test_awkward(awkward, make):
    got = {(r.doc_id, r.duplicate_of, r.exact) for r in near.pairs(awkward).collect()}
    assert got == {(6, 1, True), (8, 1, False)}
    kept = near.keep(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str((r.doc_id, r.text and r.text[:9])) for r in kept.select("doc_id", "text").collect() if r.doc_id != 10) == sorted(
        map(str, [(1, "The quick"), (2, None), (3, ""), (4, " \n\t "), (None, "The quick"), (None, None), (5, "w0 w1 w2 "), (7, "日本語 🎉 ½ é"), (9, "x" * 9)])
    )
    assert kept.filter("doc_id = 10").count() == 1
    assert near.pairs(awkward.limit(0)).count() == 0 and near.keep(awkward.limit(0)).count() == 0
    assert {(r.doc_id, r.duplicate_of) for r in near.pairs(make((5, ""), (4, ""), (3, "?"), (2, "!"))).collect()} == {(5, 4)}


def test_keep_leaves_one_of_each_group(make):
    rows = copies(6)
    gone = {r.doc_id for r in near.pairs(make(*rows)).collect()}
    assert {r.doc_id for r in near.keep(make(*rows)).collect()} == {i for i, _ in rows} - gone


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(200)]
    some = [(rng.randint(300, 700), rng.randint(300, 700)) for _ in range(220)]
    edges = [*chain, *some, (5, 5), (800, 799)]
    rng.shuffle(edges)
    want = roots(801, edges)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: want[x] for x in touched}
    assert components(spark.createDataFrame([(1, None), (2, 2)], "a bigint, b bigint")).count() == 0


def test_large_buckets_are_compared_block_by_block(spark, make, monkeypatch):
    """All pairs of two groups, whatever the size of the blocks; by force."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, near.SEARCH.hashes).astype(np.uint16)
    rows = []
    for i in range(90):
        own = np.where(rng.random(len(base)) < rng.choice([0.3, 0.5, 0.9]), base, rng.integers(0, 1 << 16, len(base)).astype(np.uint16))
        rows.append((i % 3, i, i // 4, own.tobytes()))
    rows += [(7, 500, 1, base.tobytes()), (8, 501, 1, base.tobytes()), (8, 502, 2, base.tobytes())]
    signed = {r[1]: np.frombuffer(r[3], np.uint16) for r in rows}
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] != b[2] and near.survivors(signed[a[1]][None], signed[b[1]][None])[0]}
    assert len(want) > 20
    df = spark.createDataFrame(rows, "key bigint, id bigint, root bigint, signature binary")
    for size in (1000, 7, 1):
        monkeypatch.setattr(near, "BLOCK", size)
        got = [(r.a, r.b) for r in near._across(df, near.SEARCH).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_texts_that_share_an_id_stay(make):
    """Without ``one_an_id`` only copies go, whatever their ids."""
    rng = random.Random(5)
    a, b, c, d, e = (" ".join(words(rng, 60)) for _ in range(5))
    rows = [(1, a), (1, b), (1, b), (None, c), (None, c), (None, d), (2, d), (3, None), (3, None), (None, None), (4, ""), (4, " "), (5, a + " and a little more"), (6, e)]
    far = (2**63 - 1, a)
    for extra in ([], [far], [far, (-(2**63), "some other text altogether, that is nobody's copy")]):
        kept = near.keep(make(*rows, *extra), one_an_id=False)
        got = Counter((r.doc_id if r.doc_id not in (1, None) else "shared", r.text) for r in kept.collect())
        texts = Counter(t for (_, t), n in got.items() for _ in range(n))
        assert texts[b] == 1 and texts[c] == 1 and texts[None] == 3 and texts[d] == 1 and texts[e] == 1 and texts[""] == texts[" "] == 1
        assert texts[a] + texts[a + " and a little more"] == 1 and (extra or got[2, d] == 1)
        assert sum(texts.values()) == 10 + (len(extra) > 1)
    assert near.keep(make(*rows).limit(0), one_an_id=False).count() == 0
    fine = [(i, t) for i, t in enumerate((a, b, c))]
    assert near.keep(make(*fine), one_an_id=False).count() == 3
