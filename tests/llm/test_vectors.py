"""Embeddings: links against brute force, neighbours by recall."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.llm import neighbours, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def data(n=900, dim=32, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[200:260] = x[0] + 0.08 * rng.standard_normal((60, dim))  # a group of copies
    for k in range(300, 340):  # cosines on both sides of the threshold
        x[k] = x[k - 100 + 90] + rng.uniform(0.3, 0.6) * rng.standard_normal(dim)
    x[400:420] = x[5]
    return x.astype(np.float32)


def odd(x):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    none = [None] + x[0].tolist()[1:]
    return rows + [(5000, None, 1), (5001, [0.0] * x.shape[1], 1), (5002, [math.nan] + x[0].tolist()[1:], 1), (5003, none, 1), (5004, [math.inf] + x[0].tolist()[1:], 1), (5005, [1.0, 2.0], 1), (5006, [], 1), (None, x[0].tolist(), 1)]


@pytest.mark.parametrize("tile", [4096, 64])
def test_links(spark, tile):
    x = data()
    got = vectors.near_vectors(spark.createDataFrame(odd(x), SCHEMA), 0.9, tile).collect()
    assert len(got) == len(x) + 8
    by = {r.vec_id: r for r in got}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            break
        label = new
    assert [by[i].n_links for i in range(len(x))] == link.sum(axis=1).tolist()
    assert [by[i].component_id for i in range(len(x))] == label.tolist()
    assert all(by[i].kept == (label[i] == i) for i in range(len(x)))
    assert all((by[k].n_links, by[k].component_id, by[k].kept) == (0, k, True) for k in range(5000, 5007))
    assert (by[None].n_links, by[None].component_id, by[None].kept) == (0, None, False)


def test_repeated_rows_are_vectors_of_their_own(spark):
    import duckdb
    import pandas as pd

    from roadlens.llm import registry

    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (2, [0.0, 1.0], "c"), (2, [1.0, 0.01], "d"), (3, [-1.0, 0.0], "e"), (None, [1.0, 0.0], "f"), (4, None, "g"), (5, [0.0, 0.0], "h")]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string"), 0.9).toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [r[:2] for r in rows])
    plain = lambda d: sorted(repr([None if pd.isna(v) else int(v) for v in r]) for r in d[["vec_id", "n_links", "component_id", "kept"]].astype(object).itertuples(index=False))
    assert plain(got) == plain(con.execute(registry.OP9_SQL).df())
    assert sorted(got[got.vec_id == 1].n_links) == [2, 2] and sorted(got[got.vec_id == 2].n_links) == [0, 2]


def test_products_are_exact_in_many_dimensions(spark):
    rng = np.random.default_rng(2)
    q = rng.choice(np.array([-127, 127, 126], np.int8), (40, 4097))
    q[1] = q[0]
    assert (vectors.quantised_products(q.astype(np.float32), q.astype(np.float32)) == q.astype(np.int64) @ q.astype(np.int64).T).all()
    x = rng.standard_normal((60, 2048))
    x[10:20] = x[0] + 0.4842 * rng.standard_normal((10, 2048))  # cosines about 0.9
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    got = vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 0.9, 16).collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate((link.sum(axis=1) - 1).tolist()))


def test_empty_links(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vectors.near_vectors(spark.createDataFrame([(1, None, 0)], SCHEMA)).first().n_links == 0


def test_clusters_prune_tiles(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(np.eye(8), 100, axis=0) + 0.01 * rng.standard_normal((800, 8))
    got = vectors.near_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA), 0.9, 64).collect()
    assert {r.n_links for r in got} == {99} and {r.component_id for r in got} == {100 * k for k in range(8)}


@pytest.mark.parametrize("shard, block", [(8192, 512), (200, 512), (200, 4)])
def test_neighbours(spark, shard, block, monkeypatch):
    monkeypatch.setattr(neighbours, "FEWEST", 64)
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "GROUP", 2)
    x = data(1500, 24, 7)
    df = spark.createDataFrame(odd(x), SCHEMA)
    out = neighbours.nearest(df, df.where(F.col("vec_id") % 50 == 0), 10, shard=shard).collect()
    rows = {}
    for r in out:
        rows.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(rows) == set(range(0, 1500, 50))
    hits = 0
    y = x.astype(float)
    for q, got in rows.items():
        got.sort()
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        assert [g[0] for g in got] == list(range(1, 11)) and q not in [g[1] for g in got]
        assert all(math.isclose(d[v], s, rel_tol=1e-12, abs_tol=1e-12) for _, v, s in got)
        assert [(s, v) for _, v, s in got] == sorted((s, v) for _, v, s in got)
        d[q] = np.inf
        hits += len({v for _, v, _ in got} & set(np.lexsort((np.arange(len(d)), d))[:10].tolist()))
    assert hits >= 0.9 * 10 * len(rows)


def test_few_rows(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0], 0), (100, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0)], SCHEMA)
    out = neighbours.nearest(df, df.where("vec_id = 100")).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_beside_other_columns(spark):
    rows = [(100, [1.0, 0.0], 1, 5.0), (1, [0.9, 0.1], 2, 6.0), (1, [0.5, 0.5], 3, 7.0), (2, [1.0, 0.1], 4, 8.0), (200, [0.0, 0.0], 5, 9.0), (300, None, 6, 9.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key int, score double")
    got = neighbours.nearest(df, df.where("vec_id % 100 = 0"), 3).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(100, 1, 2), (100, 2, 1), (100, 3, 1)]
    assert [round(r.score, 6) for r in got] == [0.1, round(math.hypot(0.1, 0.1), 6), round(math.hypot(0.5, 0.5), 6)]
    assert neighbours.nearest(df.limit(0), df, 3).count() == 0
