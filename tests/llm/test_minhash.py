"""Near-duplicate documents against brute force."""

import random

import pytest

from roadlens.llm import minhash


def words(n, rng):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(n)]


def brute(docs, k, percent=80):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if both and 100 * both >= percent * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}


def corpus(n_near=60):
    rng = random.Random(5)
    base = words(120, rng)
    docs = [(100 + k, " ".join(words(rng.randrange(1, 90), rng))) for k in range(60)]
    for k in range(n_near):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        docs.append((1000 + k, " ".join(w)))
    docs += [(2000 + k, "  Same   TEXT here\tand now ") for k in range(30)] + [(1999, "same text here and now")]
    docs += [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "ONE"), (6, "é É"), (7, "é é")]
    docs += [(8, "long " * 3000 + " ".join(base)), (9, "long " * 3000 + " ".join(base))]
    return docs


@pytest.mark.parametrize("region", [minhash.REGION, 12])
def test_components_are_exact(spark, region):
    docs = corpus()
    rows = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(rows, k=4, region=region, block=4 * region).collect()}
    assert got == brute(docs, 4)


def family(n_pairs, n_single, base, own, shared):
    """Documents of base common and own other words; `shared` of the others are common to a pair."""
    docs = []
    for k in range(n_pairs + n_single):
        for side in "ab" if k < n_pairs else "a":
            rest = [f"s{k}-{x}" for x in range(shared if k < n_pairs else 0)]
            rest += [f"o{k}{side}-{x}" for x in range(own - len(rest))]
            docs.append((len(docs), " ".join([f"b{x}" for x in range(base)] + rest)))
    return docs


def linked(spark, docs, **more):
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(rows, k=1, **more).collect()}


def test_split_regions_lose_no_pair(spark):
    docs = family(100, 0, 140, 30, 12)  # 0.81 in a pair, 0.70 otherwise
    want = brute(docs, 1)
    assert sum(not kept for _, _, kept in want.values()) == 100
    assert linked(spark, docs, region=12, block=24) == want


def test_close_neighbours_hide_no_pair(spark):
    docs = family(60, 180, 155, 22, 3)  # 0.81 in a pair, 0.78 otherwise
    want = brute(docs, 1)
    assert sum(not kept for _, _, kept in want.values()) == 60
    assert linked(spark, docs) == want


def test_families_of_near_copies(spark):
    """Families whose links are few among many pairs just under the threshold."""
    rng, docs = random.Random(7), []
    for f in range(3):
        base = [f"f{f}w{x}" for x in range(rng.randrange(258, 279))]
        for k in range(200):
            w = list(base)
            for at in rng.sample(range(len(w)), 2 if k < 15 else 6):
                w[at] = f"x{rng.randrange(10**7)}"
            docs.append((len(docs), " ".join(w)))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(rows, k=5, region=64, block=128).collect()}
    assert got == brute(docs, 5)


def test_common_prefixes():
    import numpy as np

    keys = np.array([[1, 1, 1], [1, 1, 2], [1, 1, 2], [1, 2, 0], [2, 0, 0]], ">u4")
    assert minhash.common_prefixes(keys).tolist() == [-1, 2, 3, 1, 0]
    assert minhash.parts_of(minhash.common_prefixes(keys), 2) == [(0, 1), (1, 3), (3, 4), (4, 5)]
    assert minhash.parts_of(np.array([-1] + [3] * 9), 4) == [(0, 2), (2, 5), (5, 7), (7, 10)]


def test_columns_and_ids_that_clash(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    rows = [(1, a, "keep1", 0, 5), (2, a.upper(), "gone", 0, 5), (3, b, "keep3", 1, 6), (3, a, "gone too", 2, 7), (None, b, "gone three", 3, 8), (None, "z " * 9, "keep null", 4, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, doc int, key int")
    kept = minhash.without_near_duplicates(df)
    assert kept.columns == df.columns and {r.id for r in kept.collect()} == {"keep1", "keep3", "keep null"}


def test_empty_and_odd_tables(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, False), (None, 0, None, False)], key=repr)
    kept = minhash.without_near_duplicates(spark.createDataFrame(rows + [(7, "a b c d e f")], schema))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, "a b c d e f"), (None, None)], key=repr)


def test_words_longer_than_a_piece(spark):
    from roadlens.llm.common import PIECE

    huge = "q" * (2 * PIECE + 9) + " tail one two three " + "z " * 900_000
    rows = spark.createDataFrame([(1, huge), (2, huge.upper()), (3, "q tail")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(rows, k=5).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_components_of_chains_and_stars(spark):
    from roadlens.llm.common import components

    edges = [(i, i + 1) for i in range(50)] + [(200, 200 + k) for k in range(1, 40)] + [(7, 7), (300, 301)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(51)} | {200 + k: 200 for k in range(40)} | {300: 300, 301: 300}
