import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyforge.llm import embedding_dedup, jaccard, shared
from tallyforge.llm.shared import components


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_components(spark):
    r = random.Random(1)
    path = [(k, k + 1) for k in range(200)]
    star = [(1000, 1001 + k) for k in range(150)]
    rest = [(2000 + r.randrange(90), 2000 + r.randrange(90)) for _ in range(60)]
    edges = path + star + rest + star[:5] + [(5, 5), (7777, 7777)]
    got = {x.node: x.component for x in components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    want = roots(8000, edges)
    seen = {x for a, b in edges for x in (a, b) if a != b}
    assert {k: got[k] for k in seen} == {k: want[k] for k in seen}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    texts = {x.node: x.component for x in components(spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")).collect()}
    assert texts == {"a": "a", "b": "a", "c": "a"}


def shingle_set(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                links.append((i, j))
    comp = roots(len(rows), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[comp[k]] = min(least.get(comp[k], 10**9), 10**9 if i is None else i)
    return sorted((10**9 if i is None else i, len(s), least[comp[k]]) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def family(r, base, n, rate):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(int(rate * len(words))):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def joined(make, rows):
    return sorted((10**9 if x.doc_id is None else x.doc_id, x.n_shingles, 10**9 if x.component_id is None else x.component_id) for x in jaccard.join_documents(make(rows)).collect())


def test_join_of_odd_rows(make, odd):
    rows = [*odd, (20, "few words"), (21, "FEW\twords"), (22, "one"), (23, "one two three four five"), (24, "One two three four five ")]
    assert joined(make, rows) == brute(rows)
    assert joined(make, []) == []


def test_join_of_families(make):
    """Large families, larger than a region that lists its pairs, with members near and beyond the threshold, and a passage that all share."""
    r = random.Random(3)
    passage = [f"p{k}" for k in range(55)]
    texts = []
    for n, size, rate in ((150, 300, 0.012), (90, 200, 0.03), (8, 120, 0.02), (40, 60, 0.05)):
        base = [f"b{r.randrange(10**6)}" for _ in range(size)]
        texts += family(r, base, n, rate)
    texts += [" ".join(passage + [f"u{r.randrange(10**6)}" for _ in range(r.randrange(5, 120))]) for _ in range(120)]
    texts += [" ".join(passage)] * 3 + [texts[0]] * 30
    r.shuffle(texts)
    rows = list(enumerate(texts))
    assert joined(make, rows) == brute(rows)


def test_one_of_each(make, odd):
    docs = make([*odd, (30, "same text here")])
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [x.doc_id for x in kept.collect()]
    assert 5 in ids and 30 not in ids and 6 not in ids and {2, 3, 4} <= set(ids)


def test_one_row_of_each(make):
    """Repeated rows, texts under one doc_id and null doc_ids leave one row of each component; blank rows all stay."""
    words = [f"b{k}" for k in range(60)]
    near = " ".join([*words[:-1], "other"])
    rows = [(7, "a b c"), (7, "a b c"), (7, "A b c"), (9, "a b c"), (7, "d e f"), (None, "unique one"), (None, "unique one"), (None, "lone text"), (1, " ".join(words)), (None, near), (None, near), (3, ""), (3, ""), (None, None)]
    got = [(x.doc_id, (x.text or "").lower()) for x in jaccard.one_of_each(make(rows)).collect()]
    want = [(7, "a b c"), (7, "d e f"), (None, "unique one"), (None, "lone text"), (1, " ".join(words)), (3, ""), (3, ""), (None, "")]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_many_ids(spark, make, odd, monkeypatch):
    """A sieve that lets everything through, and hot keys: the same rows."""
    r = random.Random(5)
    texts = family(r, [f"b{k}" for k in range(80)], 12, 0.03) + family(r, [f"c{k}" for k in range(90)], 12, 0.2)
    docs = make([*odd, *((100 + k, t) for k, t in enumerate(texts)), *[(50, texts[0])] * 30])
    want = sorted(map(repr, jaccard.one_of_each(docs).collect())), sorted(map(repr, jaccard.join_documents(docs).collect()))
    assert len(want[0]) == len({x.component_id for x in jaccard.join_documents(docs).where("n_shingles > 0").collect()}) + 3
    monkeypatch.setattr(shared, "SIEVE_WORDS", 1)
    assert (sorted(map(repr, jaccard.one_of_each(docs).collect())), sorted(map(repr, jaccard.join_documents(docs).collect()))) == want


def test_sieve_and_spread_join(spark):
    rows = spark.range(5000).selectExpr("xxhash64(id) AS key", "id")
    wanted = rows.where("id % 7 = 0").select("key")
    got = {x.id for x in shared.sifted(rows, wanted, "key", "maybe").where("maybe").collect()}
    assert got >= set(range(0, 5000, 7)) and len(got) < 5000 // 7 + 30
    assert not shared.sifted(rows, wanted.limit(0), "key", "maybe").where("maybe").count()
    left = spark.range(9000).selectExpr("CASE WHEN id < 6000 THEN 1 WHEN id < 8000 THEN id END AS k", "id")
    right = spark.createDataFrame([(1, "a"), (7000, "b"), (9999, "c")], "k long, v string")
    for how in ("inner", "left"):
        got = shared.spread_join(left, right, "k", how)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, left.join(right, "k", how).select(*got.columns).collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = shared.spread_join(left, right.hint("shuffle_hash"), "k", "left").groupBy(F.spark_partition_id()).count()
        assert dealt.agg(F.max("count")).first()[0] < 6000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("small, pivots, core", [(4, 5, 0.75), (6, 3, 0.3)])
def test_cells_hold_all_links(spark, make, monkeypatch, small, pivots, core):
    """Regions divided down to single documents, whatever the radius: no link is lost."""
    r = random.Random(small)
    passage = [f"p{k}" for k in range(40)]
    texts = []
    for n, size, rate in ((40, 120, 0.02), (30, 60, 0.04)):
        texts += family(r, passage[: size // 3] + [f"b{r.randrange(10**6)}" for _ in range(size - size // 3)], n, rate)
    texts += [" ".join(passage + [f"u{r.randrange(10**6)}" for _ in range(r.randrange(1, 60))]) for _ in range(40)]
    rows = list(enumerate(texts))
    for name, value in (("SMALL", small), ("LISTED", small), ("PIVOTS", pivots), ("CORE", core), ("BLOCK", 16), ("SHRUNK", 0.8), ("COPIES", 8)):
        monkeypatch.setattr(jaccard, name, value)
    levels = []
    step = jaccard.Join.step
    monkeypatch.setattr(jaccard.Join, "step", lambda self, cells, classes, level: levels.append(level) or step(self, cells, classes, level))
    assert joined(make, rows) == brute(rows)
    assert levels


def test_windows():
    """Any two points within both reaches are in one cell of which one is at home."""
    rng = np.random.default_rng(8)
    n = rng.integers(8, 60, 300)
    near = []
    points = (rng.random((300, 256)) < 0.3) ^ False
    for k in range(150, 300):  # close to another one
        points[k] = points[k - 150]
        points[k, rng.integers(0, 256, rng.integers(0, 12))] ^= True
    gap = (points[:, None] != points[None]).sum(2)
    for radius in (0, 20, 60, 100):
        home, guest = jaccard.cells_of(gap[:, :12], n, radius)
        for i, j in zip(*np.nonzero(gap <= np.minimum(n[:, None], n[None]) / 4), strict=True):
            near.append((i, j))
            assert home[i] == home[j] or home[i] >= 0 and guest[j, home[i]] or home[j] >= 0 and guest[i, home[j]]
    assert len(near) > 1500


def test_bounds():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 500, rng.integers(1, 400)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        b = np.unique(rng.integers(0, 500, rng.integers(1, 400)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x, y = jaccard.bitmap(a), jaccard.bitmap(b)
        size = min(len(x), len(y))
        assert np.bitwise_count(jaccard.fold(x, size) ^ jaccard.fold(y, size)).sum() <= len(np.setxor1d(a, b))
        x, y = (np.frombuffer(jaccard.bitmap(z, jaccard.WIDE), "<u8")[None] for z in (a, b))
        assert np.bitwise_count(jaccard.folded(x, min(x.nbytes, y.nbytes)) ^ jaccard.folded(y, min(x.nbytes, y.nbytes))).sum() <= len(np.setxor1d(a, b))
    for n in range(1, 300):
        need = -(-80 * n // 100)
        assert jaccard.prefix_size(n) == n - need + 1


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], "vec_id long, embedding array<float>, label int")


def brute_vectors(rows):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(np.float32(x) != 0 for x in v) for _, v in rows]
    dim = max([len(v) for (_, v), g in zip(rows, good) if g], default=0)
    x = [np.pad(np.array(v, np.float32).astype(float), (0, dim - len(v))) if g else None for (_, v), g in zip(rows, good)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if good[i] and good[j] and x[i] @ x[j] / np.sqrt(x[i] @ x[i]) / np.sqrt(x[j] @ x[j]) >= 0.95]
    comp = roots(len(rows), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[comp[k]] = min(least.get(comp[k], 10**9), i)
    n = [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    return sorted((i, n[k], least[comp[k]], i == least[comp[k]]) for k, (i, _) in enumerate(rows))


def linked(spark, rows):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.link_vectors(vectors(spark, rows)).collect())


def test_odd_vectors(spark, make):
    rows = [(1, [1, 2, 3]), (2, [2, 4, 6]), (3, [0, 0, 0]), (4, None), (5, [1, None, 2]), (6, [float("nan"), 1, 1]), (7, [float("inf"), 0, 0]), (8, [1, 2, 3]), (9, []), (10, [3, -1, 0]), (11, [1, 2]), (12, [2, 4, 0]), (13, [-0.0, 1, 0]), (14, [0.0, 1, 0])]
    assert linked(spark, rows) == brute_vectors(rows)
    assert linked(spark, rows[2:7]) == brute_vectors(rows[2:7])
    assert linked(spark, []) == []


def test_recall_and_hot_buckets(spark, make, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 24))
    rows = [base[k % 40] / np.linalg.norm(base[k % 40]) + 0.05 * rng.standard_normal(24) for k in range(200)]
    rows += [base[0]] * 60 + list(rng.standard_normal((150, 24)))
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(rows)]
    want = brute_vectors(rows)
    for block in (embedding_dedup.BLOCK, 16):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        got = linked(spark, rows)
        assert all(a[1] <= b[1] for a, b in zip(got, want))
        assert sum(a[1] for a in got) >= 0.95 * sum(b[1] for b in want)


def test_estimates_are_unbiased():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    coded = embedding_dedup.Coder(64, 8, 4)(x)
    value, wide = embedding_dedup.estimates(coded, coded, 64)
    gap = value - x @ x.T
    off = ~np.eye(300, dtype=bool)
    assert abs(gap[off].mean()) < 0.01 and (np.abs(gap) <= wide)[off].mean() > 0.99
