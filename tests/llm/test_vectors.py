"""Multi-index search, whitening and spelling variants against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracemill.llm import multi_index, registry, spelling, whitening

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, rank int, shard int, score double, x string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 0.5, "x") for i, v in rows], VECTORS)


def table(name):
    t = pq.read_table(f"{SF}/{name}.parquet")
    return {c: t[c].to_pylist() for c in t.column_names}


# -- nearest neighbours ------------------------------------------------------------------------------


def brute(ids, x, asked, k):
    x = np.array(x, float)
    n = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in asked:
        score = (x * x[ids.index(q)]).sum(axis=1) / (n * n[ids.index(q)])
        best = sorted((-s, i) for s, i in zip(score.tolist(), ids, strict=True) if i != q)[:k]
        out[q] = [(i, -s) for s, i in best]
    return out


def test_recall_and_scores_on_the_whole_table(spark):
    t = table("embeddings")
    got = {}
    for r in registry.op11_multi_index(spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(t["vec_id"], t["embedding"], [i for i in t["vec_id"] if i % 50 == 0], 5)
    assert set(got) == set(want) and all(sorted(r[0] for r in v) == [1, 2, 3, 4, 5] for v in got.values())
    assert sum(len({i for i, _ in want[q]} & {i for _, i, _ in got[q]}) for q in want) >= 0.9 * 5 * len(want)
    x = dict(zip(t["vec_id"], np.array(t["embedding"], float), strict=True))
    for q, rows in got.items():
        for _, i, s in rows:
            assert abs(s - x[q] @ x[i] / np.linalg.norm(x[q]) / np.linalg.norm(x[i])) < 1e-12
        assert [r[1] for r in sorted(rows)] == [i for _, i in sorted((-s, i) for _, i, s in rows)]


def test_small_radius_retrieves_every_code_within_it():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24))
    x = multi_index.scaled(base[rng.integers(0, 40, 3_000)] + 0.2 * rng.normal(size=(3_000, 24)))
    code = multi_index.learn(x[:1_000], 5)
    signs = multi_index.bits(code, x)
    for radius in (0, 1, 2, 3, 5, 7, 11, 24):
        shard = multi_index.Shard(code._replace(radius=radius), np.arange(len(x)), x)
        for q in range(0, 3_000, 371):
            within = np.flatnonzero((signs != signs[q]).sum(axis=1) <= radius)
            assert shard.within(shard.parts[q]).tolist() == within.tolist()


def test_few_rows_ties_copies_and_odd_vectors(spark):
    one = [1.0, 2.0, 0.0]
    rows = [(50, one), (3, one), (2, [2.0, 4.0, 0.0]), (9, [0.0, 0.0, 5.0]), (100, [0.0, 1.0, 1.0]), (7, None), (8, [0.0, 0.0, 0.0]), (11, [1.0, None, 2.0]), (12, [float("nan"), 1.0, 1.0]), (13, [float("inf"), 1.0, 1.0]), (14, []), (15, [1.0, 2.0]), (None, one), (3, one), (150, None)]
    got = {}
    for r in multi_index.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0, 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert {q: sorted(v) for q, v in got.items()} == {50: [(1, 2), (2, 3), (3, 100)], 100: [(1, 9), (2, 2), (3, 3)]}
    alone = multi_index.nearest(vectors(spark, [(50, one)]), F.col("vec_id") % 50 == 0)
    assert alone.collect() == [] and alone.columns == ["query_id", "rank", "vec_id", "score"]
    assert multi_index.nearest(vectors(spark, rows).limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_a_large_group_of_equal_vectors(spark):
    rng = np.random.default_rng(5)
    same = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, same if i % 3 else rng.normal(size=8).astype(np.float32).tolist()) for i in range(600)]
    got = {}
    for r in multi_index.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    hot = [q for q in got if q % 3]
    assert hot and all([i for _, i in sorted(got[q])] == [i for i in (1, 2, 4, 5, 7, 8) if i != q][:5] for q in hot) and all(len(v) == 5 for v in got.values())


# -- whitening ---------------------------------------------------------------------------------------


def test_whitening_against_exact_arithmetic(spark):
    t = table("embeddings")
    x = np.floor(64 * np.array(t["embedding"], float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    c = ((n * x.astype(object) - total.astype(object)) / n).astype(float)
    v = c.T @ c / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:32], axes[:, ::-1][:, :32]
    deviation = ((n * x.astype(object) - total.astype(object)) ** 2).sum(axis=1)
    white = c @ axes / np.sqrt(e)
    got = registry.op12_whitening(spark, SF).toPandas()
    assert len(got) == 32 * n and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    at = {i: k for k, i in enumerate(t["vec_id"])}
    made, sign = np.zeros((n, 32)), np.zeros(32)
    for r in got.itertuples():
        made[at[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[at[r.vec_id]] and abs(r.explained / (e[r.component - 1] / np.trace(v)) - 1) < 1e-6
    sign = np.sign((made * white).sum(axis=0))
    assert np.abs(made - white * sign).max() < 1e-6


def test_whitening_of_odd_vectors(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 1.0]), (2, [2.0, 2.0, 1.0]), (None, [5.0, 2.0, 0.0]), (4, None), (5, [1.0, None, 1.0]), (6, [float("nan")] * 3), (7, []), (8, [1.0])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == 4 * 3 and {r["n"] for r in got} == {4}
    # two independent directions: the third component has no variance
    assert {r["component"]: (r["whitened"] is None, r["explained"] == 0) for r in got} == {1: (False, False), 2: (False, False), 3: (True, True)}
    assert max(r["identity_error"] for r in got) < 1e-9
    one = whitening.whiten(vectors(spark, rows[:1])).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in one] == [(None, None, None, 0)] * 3
    assert whitening.whiten(vectors(spark, rows).limit(0)).collect() == []
    huge = whitening.whiten(vectors(spark, [(1, [3e38]), (2, [-3e38]), (3, [0.0])])).collect()
    assert {r["deviation"] for r in huge if r["vec_id"] != 3} == {None} and all(abs(r["whitened"]) < 2 for r in huge)


def test_deviations_are_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-(1 << 20), 1 << 20, (200, 7)) + 10**6
    for n in (3, 10**6, 10**11, 10**12, 3 * 10**12):
        s = [int(v) for v in rng.integers(0, n * 10**6, 7)]
        q, r = np.array([v // n for v in s]), np.array([v % n for v in s])
        want = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
        assert whitening.deviations(x, q, r, n) == [w if w < 1 << 63 else None for w in want]


# -- spelling variants -------------------------------------------------------------------------------


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    near = {w: [v for v in words if edits(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        if vs and words[b := min(vs, key=lambda v: (-words[v], v))] >= 2 * words[w]:
            form[w] = b
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def found(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("pairs", [1, 1 << 12])
def test_variants_of_random_words(spark, monkeypatch, pairs):
    """Short alphabets, so that segments are shared by many; with and without further cuts."""
    monkeypatch.setattr(spelling, "PAIRS", pairs)
    rng = random.Random(8)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))): rng.choice([3, 4, 8, 20, 20, 100]) for _ in range(400)}
    words |= {"aaaaaaaa": 3, "aaaaaaaaa": 6, "aaaaaaaaaa": 12, "aaaaaaaaaaa": 24, "aaaaaaaaaaaa": 48, "zzzzz": 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(spelling.spelling_variants(df)) == brute_variants(words)


def test_variants_of_documents(spark):
    texts = [(1, "Naïve naive NAIVE naïve-naive colour color colours COLOUR×color"), (2, None), (3, ""), (None, "colour colour"), (2**40, "ÉTUDE étude Étude étude étude étude ab abcd"), (4, "x" * 60_000 + " colour"), (4, "colour color color")]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in texts], "doc_id long, text string, word string, n int")
    import re

    for thin in (None, 97, 2):
        count = Counter()
        for i, t in texts:
            for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
                run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if thin and h % thin == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                count[run] += 1
        words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
        assert found(spelling.spelling_variants(spelling.vocabulary(df, thin=thin))) == brute_variants(words)
    assert spelling.spelling_variants(spelling.vocabulary(df.limit(0))).collect() == []
