import random

import pytest

import corpus_pipeline
from tickloom.llm import near_copies

from .conftest import EDGE_TEXTS, documents

SF = "/root/testdata/sf0.001"


def grams(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_force(rows):
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and 5 * len(a & b) >= 4 * len(a | b):
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for (x, _), r in zip(rows, root, strict=True):
        if x is not None:
            least[r] = min(least.get(r, x), x)
    return sorted((str(x), str(least.get(r))) for (x, _), r in zip(rows, root, strict=True))


def found(spark, rows):
    return sorted((str(r.doc_id), str(r.component_id)) for r in near_copies.near_copies(documents(spark, rows)).collect())


def copies():
    """Groups of edited texts, some of them beside a line that all texts share, and a chain from copy to copy."""
    draw, line = random.Random(3), "this very line is found in each and every text".split()
    rows = []
    for group in range(12):
        words = [f"g{group}w{draw.randrange(10**6)}" for _ in range(draw.choice((8, 60, 200)))]
        for _ in range(10):
            edited = list(words)
            for _ in range(draw.randrange(6)):
                edited[draw.randrange(len(edited))] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(line + edited if group % 2 else edited)))
            if group == 0:
                words = edited
    return rows


@pytest.mark.parametrize("often", [3, 10**6])
def test_against_brute_force(spark, monkeypatch, often):
    monkeypatch.setattr(near_copies, "OFTEN", often)
    rows = copies()
    assert found(spark, rows) == brute_force(rows)
    assert len({c for _, c in brute_force(rows)}) < len(rows)


def test_long_texts_of_other_lengths(spark):
    """Sketches of several widths: long texts that share much, about at the threshold and below, beside shorter parts of them."""
    draw = random.Random(5)
    words = [f"w{draw.randrange(10**7)}" for _ in range(9000)]
    rows = []
    for n in (400, 520, 4000, 4900, 5600, 9000):
        for part in (0.0, 0.015, 0.021, 0.03, 0.1):
            edited = words[:n]
            for i in draw.sample(range(n), int(part * n)):
                edited[i] = f"x{draw.randrange(10**7)}"
            rows.append((len(rows), " ".join(edited)))
    assert found(spark, rows) == brute_force(rows) and len({c for _, c in brute_force(rows)}) > 8


def test_edge_cases(spark):
    assert found(spark, EDGE_TEXTS) == brute_force(EDGE_TEXTS)
    assert found(spark, []) == []


def test_documents_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(spark, rows) == brute_force(rows)


def test_stage_drops_near_copies_beyond_two_bits(spark):
    """In sf0.001, 145 and 177 are near copies of 6 and 1, with fingerprints 11 and 17 bits apart."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id in (1, 6, 145, 177)")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [1, 6]


def test_one_large_cluster(spark, monkeypatch):
    """A cluster beside a few outsiders that share shingles with it: no key of confirmed has much more than PART_SETS sets."""
    monkeypatch.setattr(near_copies, "PART_SETS", 16)
    monkeypatch.setattr(near_copies, "BLOCK", 32)
    monkeypatch.setattr(near_copies, "OFTEN", 10**6)
    parts, draw, in_parts = [], random.Random(7), near_copies.in_parts
    monkeypatch.setattr(near_copies, "in_parts", lambda pairs: parts.append(in_parts(pairs).groupBy("u", "part").count().toPandas()) or in_parts(pairs))
    words = [f"w{draw.randrange(10**7)}" for _ in range(120)]
    rows = []
    for i in range(400):
        edited = list(words)
        edited[draw.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(edited)))
    for i in range(400, 406):
        rows.append((i, " ".join([*words[:40], *(f"y{i}z{j}" for j in range(60))])))
    assert found(spark, rows) == brute_force(rows) and len({c for _, c in brute_force(rows)}) == 7
    parts = [p for p in parts if len(p)]
    assert max(p["count"].max() for p in parts) <= 3 * 16 + 1
    assert max(p.groupby("u")["count"].sum().max() for p in parts) > 300


def test_blocks_of_one_component_do_not_meet(spark, monkeypatch):
    """Nodes of different roots meet in one cell of their token, as do none of two blocks of one root."""
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    roots = {1: [1] * 200 + [2] * 30 + [3, 4, 5], 2: [1] * 40 + [9] * 40, 3: [1, 1, 2, 2, 3], 4: [7] * 50, 5: [1, 2, 3]}
    rooted = spark.createDataFrame([(t, 1000 * t + i, r) for t, rs in roots.items() for i, r in enumerate(rs)], "token long, node long, root long")
    cells = {}
    for r in near_copies.blocks_meet(rooted).collect():
        cells.setdefault((r.token, r.lo, r.hi), []).append((r.block, r.node, r.root))
    met = {}
    for (token, lo, hi), rows in cells.items():
        for i, (b, u, ru) in enumerate(rows):
            for c, v, rv in rows[:i]:
                if ru != rv and (lo == hi or b != c):
                    met[min(u, v), max(u, v)] = met.get((min(u, v), max(u, v)), 0) + 1
    wanted = {(1000 * t + j, 1000 * t + i) for t, rs in roots.items() if t < 4 for i, r in enumerate(rs) for j in range(i) if rs[j] != r}
    assert set(met) == wanted and set(met.values()) == {1}
    # 25 and 4 blocks of large roots and one mixed block: all pairs of their kinds, and the mixed one with itself
    assert len([c for c in cells if c[0] == 1]) == 25 * 4 + 25 + 4 + 1 and len([c for c in cells if c[0] == 2]) == 5 * 5
