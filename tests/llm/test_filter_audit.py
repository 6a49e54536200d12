"""The filter audit against a plain loop over all orders, and against DuckDB on odd tables."""

from __future__ import annotations

import random
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from tickloom.llm import filter_audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(rows: list[tuple], filters: str) -> dict[tuple, tuple]:
    """rows: (part, letters that fail, good, toxic)."""
    out, total = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations(filters)):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in own) - len(gone)
                out[part, order, step] = (len(left), len(gone), redundant, sum(r[1] == f for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
                total[part, f] += len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def by_key(df) -> dict[tuple, tuple]:
    rows = df.select(COLUMNS).collect()
    out = {tuple(r)[:3]: tuple(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_against_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["", "a", "b"]), "".join(f for f in "PQRS" if rng.random() < 0.4), rng.random() < 0.3, rng.random() < 0.2) for _ in range(500)] + [("all gone", "PQRS", True, True)] * 3 + [("clean", "", True, False)]
    df = spark.createDataFrame(rows, "part string, fails string, good boolean, toxic boolean").select("part", *(F.contains("fails", F.lit(f)).alias(f) for f in "PQRS"), "good", "toxic")
    assert by_key(filter_audit.audit(df, list("PQRS"))) == plain(rows, "PQRS")


def test_each_state_once(spark):
    """2^n - 1 states are counted for n! orders, and edges add up to what each filter removes first of all."""
    rows = spark.createDataFrame([("x", True, False, True, False, False)], "part string, A boolean, B boolean, C boolean, good boolean, toxic boolean")
    edges = filter_audit.walk(rows, list("ABC")).collect()
    assert len({(r.state, r["filter"]) for r in edges}) == len(edges)
    assert {r.state for r in edges} == {0, 2}  # the one row is gone after A or C
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_odd_tables(spark, tmp_path):
    import duckdb

    copies = "Word " * 300
    docs = [(1, None, "s"), (2, "", "s"), (None, copies, None), (3, copies, None), (3, copies, "s"), (4, copies, ""), (5, "ABC # x", "t"), (6, "w%d " * 3, "t"), (7, " ".join(f"w{i}" for i in range(100_000)), "t")]
    labels = [(3, 1, 0), (3, 0, 1), (4, None, None), (None, 1, 1), (99, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"A": F.lit(1), "part": F.lit("p"), "good": F.lit(2), "filter": F.lit("f")})
    n = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("t"))
    got = by_key(filter_audit.filter_audit(d, n))
    con = duckdb.connect()
    for name, df in (("documents", d), ("labels", n)):
        df.write.parquet(f"file://{tmp_path}/{name}")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    want = con.sql(filter_audit.ORACLE).select(*COLUMNS).fetchall()
    assert got == {r[:3]: r[3:] for r in want} and len(got) == 600 * 3
    assert filter_audit.filter_audit(d.limit(0), n).count() == 0
    assert {r.good_lost for r in filter_audit.filter_audit(d, n.limit(0)).collect()} == {0}
