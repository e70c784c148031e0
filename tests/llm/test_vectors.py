"""Operators on embeddings and the importance resampling, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scorelark.llm import pivots, resampling, whitening

SCHEMA = "vec_id long, embedding array<{}>, label int, n int, component string, d int, h long, root string, size int, `class` string, vec string, key string"
EXTRA = (1, "c", 2, 3, "r", 4, "k", "v", "k2")
D = 12


@pytest.fixture(scope="module")
def vectors(spark):
    def build(rows, kind="double"):
        full = [(i, v, label, *EXTRA) for i, v, label in rows]
        df = spark.createDataFrame(full, SCHEMA.format(kind))
        return df.repartition(3) if full else df

    return build


def odd(n=300, seed=1):
    """Clusters of near vectors, copies, scaled copies, a chain, and everything that is no vector."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, D)) * np.linspace(3, 0.5, D) + 0.3
    rows = [(i, base[i].tolist(), i % 3) for i in range(n)]
    for i in range(40):
        rows.append((1000 + i, (base[i] + 0.05 * rng.standard_normal(D)).tolist(), i % 3))
    rows += [(2000 + i, base[0].tolist(), 0) for i in range(5)] + [(2000, base[0].tolist(), 0), (None, base[1].tolist(), 1), (2100, (7 * base[2]).tolist(), 2), (2101, base[3].tolist(), None), (2102, base[3].tolist(), 2)]
    chain = [np.eye(D)[0] * math.cos(0.15 * k) + np.eye(D)[1] * math.sin(0.15 * k) for k in range(8)]
    rows += [(3000 + k, v.tolist(), 1) for k, v in enumerate(chain)]
    bad = [None, [], [0.0] * D, [1.0] * (D - 1) + [None], [1.0] * (D - 1) + [float("nan")], [1.0] * (D - 1) + [float("inf")]]
    rows += [(4000 + k, v, 0) for k, v in enumerate(bad)] + [(4100, [1.0, 2.0], 0), (4101, [1.0, 2.01], 0), (4102, [-0.0, 1.0], 0), (4103, [0.0, 1.0], 0)]
    return rows


def is_vector(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v)


def brute_links(rows):
    good = [k for k, (_, v, label) in enumerate(rows) if label is not None and is_vector(v) and any(v)]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                u, v = np.array(rows[a][1]), np.array(rows[b][1])
                if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.98:
                    links[a] += 1
                    links[b] += 1
                    parent[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, links[k], least.get(top(k)), i == least.get(top(k))) for k, (i, *_) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("kind", ["double", "float"])
def test_near_vectors(spark, vectors, kind):
    rows = odd()
    if kind == "float":
        rows = [(i, v and [c if c is None else float(np.float32(c)) for c in v], label) for i, v, label in rows]
    expected = brute_links(rows)
    for block in (4096, 7):  # one block, and many pairs of blocks
        got = pivots.near_duplicates(spark, vectors(rows, kind), block=block)
        assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
        assert sorted(map(tuple, got.collect()), key=repr) == expected
    assert sum(n for _, n, *_ in expected) > 100


def test_no_vectors(spark, vectors):
    assert pivots.near_duplicates(spark, vectors([])).count() == 0
    alone = [(7, None, None), (None, [1.0], None), (8, [0.0], 1)]
    assert sorted(map(tuple, pivots.near_duplicates(spark, vectors(alone)).collect()), key=repr) == sorted([(7, 0, 7, True), (None, 0, None, True), (8, 0, 8, True)], key=repr)


def test_large_entries_and_a_large_group(spark, vectors):
    """Entries whose squares overflow; a hub of near vectors, mostly different, that one list can't hold in a block."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(D)
    rows = [(i, ((centre + 0.02 * rng.standard_normal(D)) * 1e200).tolist(), 5) for i in range(400)] + [(1000 + i, (rng.standard_normal(D) * 1e-200).tolist(), 5) for i in range(100)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_duplicates(spark, vectors(rows), block=64).collect()}
    assert all(got[i] == (399, 0) for i in range(400))


def test_recall_of_the_index():
    """Pairs just above the threshold, by brute force: at least 0.9 are candidates at any number of pivots."""
    rng = np.random.default_rng(0)
    for d, n in ((8, 64), (64, 100), (64, 1000), (64, 4096), (256, 200)):
        for spread in (0.3, 1.0, 5.0):
            x = rng.standard_normal((10, d))[rng.integers(0, 10, n + 500)] + spread * rng.standard_normal((n + 500, d))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            u, refs = x[n:], x[:n]
            v = rng.standard_normal(u.shape)
            v -= (v * u).sum(1, keepdims=True) * u
            v = 0.981 * u + math.sqrt(1 - 0.981**2) * v / np.linalg.norm(v, axis=1, keepdims=True)
            a, b = (pivots.nearest(y, refs, pivots.NEAREST) for y in (u, v))
            assert ((a[:, :, None] == b[:, None, :]).sum((1, 2)) >= pivots.SHARED).mean() >= 0.9


@pytest.mark.parametrize("cosine", [0.999, 0.985, 0.97, 0.95, 0.9])
def test_recall_within_a_large_group(cosine):
    """A third of all vectors is one group of near vectors, and so are the sampled pivots."""
    rng = np.random.default_rng(1)
    n, d, centre = 3000, 64, np.eye(64)[0]
    x = np.concatenate([centre + math.sqrt(1 / cosine - 1) * rng.standard_normal((n // 3, d)) / math.sqrt(d), rng.standard_normal((n - n // 3, d))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    refs = pivots.References({d: x[rng.choice(n, 600, replace=False)]}).of(d)
    near = pivots.nearest(x[: n // 3], refs, pivots.NEAREST)
    i, j = np.nonzero(np.triu(x[: n // 3] @ x[: n // 3].T >= 0.98, 1))
    found = [len(np.intersect1d(near[a], near[b])) >= pivots.SHARED for a, b in list(zip(i, j, strict=True))[:3000]]
    assert len(refs) > 300 and (not found or np.mean(found) >= 0.99)


def test_merging_labels():
    label = pivots.merge(np.arange(8), np.array([5, 3, 7, 6]), np.array([3, 1, 6, 0]))
    assert label.tolist() == [0, 1, 2, 1, 4, 1, 0, 0]


def test_whitening(spark, vectors):
    rows = [r for r in odd() if r[0] != 4000]
    good = [(i, v) for i, v, _ in rows if is_vector(v) and len(v) == D]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good], object)
    n, total = len(x), x.sum(0)
    centred = ((n * x - total) / n).astype(float)
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    got = whitening.whiten(spark, vectors(rows), components=5).collect()
    assert len(got) == 5 * n and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter((i, int(((n * row - total) ** 2).sum())) for (i, _), row in zip(good, x, strict=True))
    plain = centred @ vector[:, :5] / np.sqrt(value[:5])
    for k in range(5):
        own = Counter((r.vec_id, round(r.whitened, 6) + 0.0) for r in got if r.component == k + 1)
        assert own in [Counter((i, round(s * w, 6) + 0.0) for (i, _), w in zip(good, plain[:, k], strict=True)) for s in (1, -1)]
        assert all(abs(r.explained - value[k] / value.sum()) < 1e-12 for r in got if r.component == k + 1)


def test_whitening_of_little(spark, vectors):
    assert whitening.whiten(spark, vectors([])).count() == 0
    assert whitening.whiten(spark, vectors([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).count() == 0
    rng = np.random.default_rng(2)
    flat = rng.standard_normal((60, 3)) @ (4 * rng.standard_normal((3, 20)))  # three directions and the rounding of x
    model = whitening.fit(spark, vectors([(i, v.tolist(), 0) for i, v in enumerate(flat)]))
    assert len(model.eigenvalues) == 20 and model.explained[:3].sum() > 0.99
    huge = [(i, [1e18, float(i)], 0) for i in range(3)] + [(9, [1.0, 2.0], 0), (10, [3.0, 5.0], 0)]
    assert {r.vec_id for r in whitening.whiten(spark, vectors(huge)).collect()} == {9, 10}  # no long holds 64e18
    wide = [(i, [float(2**50 + i * 2**40), float(i % 2)], 0) for i in range(9)]
    assert {r.deviation for r in whitening.whiten(spark, vectors(wide)).collect()} >= {None}


def spectrum(values, seed=3):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize("values", [np.linspace(9, 1, 200), np.r_[np.full(40, 5.0), np.linspace(1, 0.1, 160)], np.r_[np.arange(6, 0, -1.0), np.zeros(194)], np.r_[3.0, np.zeros(199)], np.geomspace(1, 1e-9, 200), np.r_[np.full(20, 2.0), np.full(180, 1.0)]])
def test_lanczos(values):
    """Even, repeated, deficient (breakdowns) and steep spectra."""
    a = spectrum(values)
    value, vector, passes, restarts, residual = whitening.lanczos(lambda b: a @ b, 200, 32)
    assert np.allclose(value, np.sort(values)[::-1][:32], atol=1e-12 * values.max()) and residual < 1e-10
    assert np.allclose(vector.T @ vector, np.eye(32), atol=1e-10) and passes <= 8
    assert restarts or np.linalg.matrix_rank(a) > 40


def plain_resample(docs, target, n, buckets, percent, least, seed):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    runs = lambda w: [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in runs(words(t)))
    t_ = Counter(bucket(f) for t in target for f in runs(words(t)))
    S, T = sum(s.values()), sum(t_.values())
    gain = lambda b: math.floor(1000 * math.log((t_[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for k, (i, t) in enumerate(docs):
        w = words(t)
        f = [gain(bucket(x)) for x in runs(w)]
        weight = sum(f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), k])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0], r[5]))
    rank = {r[5]: k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return [(*r[:5], rank.get(r[5])) for r in out]


@pytest.mark.parametrize("n, hot", [(1, 1 << 18), (1, 20), (3, 50), (2, 0)])
def test_resampling(spark, make, edge, n, hot):
    """All words known to every task, few, none; runs of several words."""
    rng = random.Random(5)
    docs = [(d, t) for d, t, *_ in edge]
    target = [t for _, t in docs if t and rng.random() < 0.2] + [None, "", "Words that no document has; über naïve"]
    got = resampling.resample(spark, make(edge), spark.createDataFrame([(t, 1) for t in target], "text string, weight int"), n, 997, 30, 20, 7, hot)
    expected = plain_resample(docs, target, n, 997, 30, 20, 7)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    rows = got.collect()
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=repr) == sorted((r[:5] for r in expected), key=repr)
    drawn = lambda rows: sorted((r[5], r[4], -1 if r[0] is None else r[0]) for r in rows if r[5] is not None)
    assert drawn([tuple(r[c] for c in [*columns, "rank"]) for r in rows]) == drawn(expected)


def test_resampling_of_nothing(spark, make):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(spark, make([]), none).count() == 0
    got = resampling.resample(spark, make([(1, "a b c " * 10), (2, None)]), none, least_words=2, percent=100).collect()
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in got) == [(1, 30, 1), (2, 0, None)]


def test_resampling_of_a_long_text(spark, make):
    rng = random.Random(8)
    text = " ".join("w%x" % rng.randrange(1 << 18) for _ in range(800_000))  # about 5 MB
    assert len(text) > 5_000_000
    docs = [(1, text), (2, "short text")]
    got = resampling.resample(spark, make(docs), make([(1, "w1 w2 w3")]).select("text"), hot=1000).collect()
    assert sorted(map(tuple, got)) == sorted(plain_resample(docs, ["w1 w2 w3"], 1, 10_000, 10, 20, 2024))
