import numpy as np
import pytest
import xxhash

from tickloom.llm import simhash
from tickloom.llm.queries import QUERIES

from .conftest import EDGE_TEXTS, documents

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    data = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    words = data.split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(ids))]


def check(spark, rows, result):
    ids, prints = [r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows]
    want = sorted(zip(map(str, ids), prints, map(str, plain_components(ids, prints))))
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in result.collect()) == want


def test_edge_cases(spark):
    check(spark, EDGE_TEXTS, simhash.near_duplicates(documents(spark, EDGE_TEXTS)))


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    result = QUERIES["op2_simhash_dedup"](spark, SF)
    assert result.columns == ["doc_id", "fingerprint", "component_id"]
    ids, prints = [r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows]
    want = sorted(zip(ids, (f"{p:016x}" for p in prints), plain_components(ids, prints)))
    assert sorted(map(tuple, result.collect())) == want


@pytest.mark.parametrize("crowded", [1024, 3])
def test_anchors_lose_no_link(crowded, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    draw = np.random.default_rng(5)
    prints = set()
    for center in draw.integers(0, 2**63, 60, dtype=np.uint64):
        for _ in range(25):
            x = center
            for bit in draw.choice(64, draw.integers(0, 4), replace=False):
                x ^= np.uint64(1) << np.uint64(bit)
            prints.add(int(x))
    fp = np.array(sorted(prints), np.uint64)
    anchor, f, home = simhash.replicate(fp)
    order = np.lexsort((~home, anchor))
    found, crowd = set(), set()
    for u, v, is_crowd in simhash.compare(anchor[order], f[order], home[order], 2):
        if is_crowd:
            crowd |= set(u.tolist())
        else:
            found |= set(zip(u.tolist(), v.tolist()))
    found |= {(a, b) for a in crowd for b in crowd if bin(a ^ b).count("1") <= 2}
    index = {x: i for i, x in enumerate(fp.tolist())}

    def classes(pairs):
        u, v = simhash.forest(np.array([index[a] for a, _ in pairs]), np.array([index[b] for _, b in pairs]))
        return dict(zip(u.tolist(), v.tolist()))

    near = np.argwhere(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2)
    assert classes(list(found)) == classes([(int(fp[i]), int(fp[j])) for i, j in near])
    assert bool(crowd) == (crowded == 3)


def test_links_and_components_in_spark(spark):
    center = 0x0123456789ABCDEF
    values = [center] + [center ^ (1 << i) for i in range(60)] + [center ^ (7 << i) for i in range(0, 48, 8)] + [0, 1]
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    from tickloom.llm.components import components

    got = {r.node: r.root for r in components(simhash.links(prints)).collect()}
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= 2:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    classes = {}
    for v, c in zip(values, root):
        classes.setdefault(c, []).append(v)
    assert got == {v: min(members) for members in classes.values() if len(members) > 1 for v in members}
