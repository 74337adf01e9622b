"""The grid order join: skipping where the data allows it, precision, repeated ids."""

import numpy as np

from tessera.llm import vector_dup


def compared(x, k, leaf=vector_dup.LEAF):
    """Share of the pairs of leaves that a join of a sequence with itself compares, and the pairs it finds."""
    eps = float(np.sqrt(2 - 2 * vector_dup.COSINE))
    _, vec = np.linalg.eigh(np.cov(x.T))
    axes = np.ascontiguousarray(vec[:, ::-1][:, :k])
    x = x[np.lexsort(np.floor(x @ axes / eps).T[::-1])]
    found = []
    vector_dup._pairs_within(x, x @ axes, x, x @ axes, eps, vector_dup.COSINE, True, found)
    n = -(-len(x) // leaf)
    return len(found) / (n * (n + 1) / 2), sum(len(i) for i, _ in found), x


def test_most_is_skipped_where_few_axes_hold_the_variance():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(4096, 3)), rng.normal(size=(4096, 29)) * 0.02], axis=1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    share, pairs, x = compared(x, 6)
    s = x @ x.T
    assert share < 0.5 and pairs == (np.triu(s, 1) >= vector_dup.COSINE).sum()


def test_nothing_is_lost_where_no_axis_stands_out():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 64))
    x[750:] = x[:750] + rng.normal(size=(750, 64)) * 0.25
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    share, pairs, x = compared(x, 8)
    assert pairs == (np.triu(x @ x.T, 1) >= vector_dup.COSINE).sum() > 500


def test_single_and_double_precision_and_repeated_ids(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 8))
    rows = [(k, (v * (1e200 if k % 3 == 0 else 1.0)).tolist(), k // 2 % 2) for k, v in enumerate(np.repeat(base, 2, axis=0) + rng.normal(size=(60, 8)) * 0.05)]
    rows += [(5, rows[5][1], 0), (5, rows[7][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for data in (df, df.where("vec_id % 3 <> 0").selectExpr("vec_id", "cast(embedding as array<float>) as embedding", "label")):
        own = [(r["vec_id"], np.array(r["embedding"], float), r["label"]) for r in data.collect()]
        unit = [v / np.abs(v).max() for _, v, _ in own]
        unit = [v / np.linalg.norm(v) for v in unit]
        links, up = [0] * len(own), {i: i for i, _, _ in own}
        for a in range(len(own)):
            for b in range(len(own)):
                if a != b and own[a][2] == own[b][2] and unit[a] @ unit[b] >= 0.93:
                    links[a] += 1
                    x, y = up[own[a][0]], up[own[b][0]]
                    up = {i: min(x, y) if c in (x, y) else c for i, c in up.items()}
        got = vector_dup.near_vectors(data, block=8).collect()
        assert sorted((r["vec_id"], r["n_links"]) for r in got) == sorted((i, n) for (i, _, _), n in zip(own, links)) and sum(links) > 10
        assert all(r["component_id"] == up[r["vec_id"]] and r["kept"] == (r["vec_id"] == up[r["vec_id"]]) for r in got)


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, label int, n_links string, kept int"
    rows = [(1, [1.0, 0.0], 1, "x", 0), (2, [1.0, 0.0], 1, "x", 0), (None, [1.0, 0.0], 1, "x", 0), (4, [0.0, 0.0], 1, "x", 0), (6, None, None, None, None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dup.near_vectors(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), None: (0, None, True), 4: (0, 4, True), 6: (0, 6, True)}
    assert vector_dup.near_vectors(spark.createDataFrame([], schema)).collect() == []
