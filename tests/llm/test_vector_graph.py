"""Near-duplicate vectors against brute force: recall, exactness of what is linked, crowds, parts, odd tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import vector_graph
from tickloom.llm.queries import QUERIES


def brute(rows: list[tuple], threshold: float = 0.95) -> list[tuple]:
    """rows: (id, vector); (id, n_links, component_id, kept) in their order."""
    links: list[set[int]] = [set() for _ in rows]
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for size in {len(rows[i][1]) for i in good}:
        own = [i for i in good if len(rows[i][1]) == size]
        x = np.array([rows[i][1] for i in own], float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= threshold), strict=True):
            if a != b:
                links[own[a]].add(own[b])
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, to in enumerate(links):
        for j in to:
            root[top(i)] = top(j)
    ids: dict[int, list] = {}
    for i, (k, _) in enumerate(rows):
        ids.setdefault(top(i), []).extend([] if k is None else [k])
    least = [min(ids[top(i)], default=None) for i in range(len(rows))]
    return [(k, len(links[i]), least[i], k == least[i]) for i, (k, _) in enumerate(rows)]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def told(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


def crowds(seed: int, alone: int, groups: list[int], noise: float) -> list[tuple]:
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=(alone, 32))]
    x += [rng.normal(size=(1, 32)) + noise * rng.normal(size=(n, 32)) for n in groups]
    x = np.concatenate(x)
    ids = rng.permutation(len(x))
    return [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]


@pytest.mark.parametrize(("part", "target"), [(6_000, 1_500), (150, 300)])
def test_recall(spark, monkeypatch, part, target):
    """Groups of near copies at all similarities about the threshold, in one part and in many: no link is wrong, and 0.97 of
    them are found; so are all vectors of a crowd that is half of the table."""
    monkeypatch.setattr(vector_graph, "PART", part)
    monkeypatch.setattr(vector_graph, "TARGET", target)
    rows = crowds(3, 700, [2] * 100 + [10] * 10, 0.2) + [(10_000 + i, v) for i, v in crowds(4, 0, [700], 0.05)]
    want, got = sorted(brute(rows)), sorted(map(tuple, vector_graph.near_vectors(table(spark, rows)).collect()))
    assert [w[0] for w in want] == [g[0] for g in got]
    assert all(g[1] <= w[1] for w, g in zip(want, got, strict=True))
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want) > 0
    assert sum(g[2] == w[2] for w, g in zip(want, got, strict=True)) >= 0.99 * len(rows)


def test_copies_are_one_node(spark):
    """Thousands of copies of one vector are one node of the graph, and count as links of all."""
    v = [1.0, 2.0, 3.0, 0.0]
    rows = [(i, v) for i in range(3_000)] + [(5_000, [1.0, 2.0, 3.1, -0.0]), (5_001, [-1.0, 2.0, 3.0, 0.0]), (5_002, [2.0, 4.0, 6.0, 0.0])]
    got = {r[0]: tuple(r)[1:] for r in vector_graph.near_vectors(table(spark, rows)).collect()}
    assert got[0] == (3_001, 0, True) and got[2_999] == (3_001, 0, False)
    assert got[5_000] == (3_001, 0, False) and got[5_002] == (3_001, 0, False) and got[5_001] == (0, 5_001, True)


def test_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [1e-300, 1e-302]), (10, [1e300, 0.0]), (11, [0.95, math.sqrt(1 - 0.95**2) - 1e-9]), (12, [0.95, math.sqrt(1 - 0.95**2) + 1e-6]), (None, [1.0, 0.0]), (None, [0.0, -1.0]), (None, None), (7, [1.0, 0.0]), (13, [-0.0, -1.0])]
    df = table(spark, rows).withColumns({"id": F.lit("x"), "key": F.lit("y"), "node": F.lit(1), "label": F.lit(None).cast("int"), "vec": F.lit("z")})
    out = vector_graph.near_vectors(df)
    assert told(out) == sorted(brute(rows), key=repr)
    assert out.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert vector_graph.near_vectors(df.limit(0)).count() == 0
    assert told(vector_graph.near_vectors(df.where("vec_id in (1, 3)"))) == [(1, 0, 1, True), (3, 0, 3, True)]


def test_recall_is_measured(spark):
    rows = crowds(5, 50, [30], 0.05)
    packed = [(i, 1, np.array(v).tobytes()) for i, v in rows]
    nodes = spark.createDataFrame(packed, "node long, copies long, vec binary")
    found = vector_graph.linked(nodes, 0.95, 3, 48)
    assert vector_graph.recall(nodes, found, 0.95) == 1.0
    assert 0 < vector_graph.recall(nodes, found.where("node % 2 = 0"), 0.95) < 0.9


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert told(QUERIES["op11_vector_dedup"](spark, d)) == sorted(brute(rows), key=repr)
