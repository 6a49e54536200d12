"""Filter interaction audit: what each filter removes in every order of the filters.

The orders form a trie of prefixes. What a prefix leaves depends only on which filters it holds, so the trie is walked depth
first and each set of filters is visited once: the survivors of a set are a persisted DataFrame made from those of the set
before it, their removals by each further filter are counted by part in one aggregation, and a set that another order has
already led to is taken from memory. With n filters that is 2^n states and n * 2^(n-1) edges instead of the n! orders, and at
most n frames are persisted at a time. The survivors hold one narrow row a document: its part, its failures, its labels.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.storagelevel import StorageLevel

from .common import saved, temporary

WORD = r"[^\x20\x09-\x0D]+"
#: Parts of a text's copies: the rows of the most frequent text go to so many tasks.
PARTS = 32


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: part, whether it fails A to E, and whether it is labelled good or toxic.

    Null texts are empty, a null source is the empty part. A document is a copy (E) if a smaller doc_id has the same text,
    told by its SHA-256; rows with a null id neither are copies nor have any. Rows with one id are judged each for itself.
    Labels of one id count together: good (toxic) if any row says so.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words, least_caps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    told = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), text.alias("text"), words.alias("words"), least_caps.alias("caps")).select(
        "doc_id", "part", (F.size("words") < 200).alias("A"), (100 * F.size(F.array_distinct("words")) < 50 * F.size("words")).alias("B"), (100 * F.col("caps").cast("long") > 2 * F.length("text")).alias("C"), F.col("text").rlike("[#$%&*|]").alias("D"), F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    told = saved(told, "told").withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    by_slice = told.groupBy("digest", "slice").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    first = by_slice.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").select("digest", "first")
    first = by_slice.select("digest", "slice").join(first, "digest")
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = told.join(first, ["digest", "slice"], "left").join(marks, "doc_id", "left")
    return rows.select("part", "A", "B", "C", "D", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).alias("E"), F.coalesce(F.col("good") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))


def _of(state: frozenset[str], filters: list[str]) -> int:
    return sum(1 << i for i, f in enumerate(filters) if f in state)


def walk(rows: DataFrame, filters: list[str]) -> DataFrame:
    """The edges of the trie with its prefixes merged: part, state (bits of the filters applied before), filter, kept,
    removed, good_lost, toxic_lost. A part that a state has no rows of has no edges there."""
    visited: dict[frozenset[str], DataFrame] = {}

    def visit(state: frozenset[str], survivors: DataFrame) -> None:
        left = [f for f in filters if f not in state]
        if state in visited or not left:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        count = lambda x: F.count_if(x)
        edges = survivors.groupBy("part").agg(F.count("*").alias("n"), *(c for f in left for c in (count(F.col(f)).alias(f), count(F.col(f) & F.col("good")).alias(f"{f}_good"), count(F.col(f) & F.col("toxic")).alias(f"{f}_toxic"))))
        long = F.explode(F.array(*(F.struct(F.lit(f).alias("filter"), (F.col("n") - F.col(f)).alias("kept"), F.col(f).alias("removed"), F.col(f"{f}_good").alias("good_lost"), F.col(f"{f}_toxic").alias("toxic_lost")) for f in left))).alias("x")
        visited[state] = saved(edges.select("part", F.lit(_of(state, filters)).alias("state"), long).select("part", "state", "x.*"), "edges")
        for f in left:
            visit(state | {f}, survivors.where(~F.col(f)))
        survivors.unpersist()

    visit(frozenset(), rows)
    return reduce(DataFrame.unionByName, visited.values())


def audit(rows: DataFrame, filters: list[str]) -> DataFrame:
    """For ``rows`` (part, a boolean column for each filter that says whether the row fails it, good, toxic): part,
    filter_order, step and the counts of each step of each order. Every part of the table gets all its rows, zeros included;
    an empty table gives none. Filters are named by one letter each, and their failures aren't null."""
    n = len(filters)
    with temporary(rows.sparkSession):
        edges = saved(walk(rows, filters), "trie")
        weight = lambda state: F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), F.bit_count(state) + 1)
        by_filter = edges.groupBy("part", "filter").agg(F.sum(F.when(F.col("state") == 0, F.col("removed")).otherwise(0)).alias("failing"), F.sum(F.when(F.bit_count("state") == n - 1, F.col("removed")).otherwise(0)).alias("unique_fails"), F.sum(F.col("removed") * weight(F.col("state"))).alias("shapley"))
        steps = [{"filter_order": "".join(o), "step": i + 1, "filter": f, "state": _of(frozenset(o[:i]), filters)} for o in permutations(filters) for i, f in enumerate(o)]
        kind = ArrayType(StructType([StructField("filter_order", StringType()), StructField("step", IntegerType()), StructField("filter", StringType()), StructField("state", IntegerType())]))
        all_steps = F.from_json(F.lit(json.dumps(steps)), kind)
        spine = by_filter.select("part").distinct().select("part", F.explode(all_steps).alias("s")).select("part", "s.*")
        out = spine.join(by_filter, ["part", "filter"]).join(edges, ["part", "filter", "state"], "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        return saved(out.select("part", "filter_order", "step", zero("kept").alias("kept"), zero("removed").alias("removed"), (F.col("failing") - zero("removed")).cast("long").alias("redundant"), F.col("unique_fails").cast("long"), zero("good_lost").alias("good_lost"), zero("toxic_lost").alias("toxic_lost"), F.col("shapley").cast("long")), "audit", keep=True)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E (words, distinct words, capitals, symbols, copies) over ``docs``; see failures().

    Empty tables give no rows; columns other than those named in failures() are ignored.
    """
    with temporary(docs.sparkSession):
        rows = saved(failures(docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality", "toxic")), "failures", keep=True)
    return audit(rows, list("ABCDE"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
firsts AS (SELECT text, min(doc_id) AS f FROM t GROUP BY text),
d AS (SELECT row_number() OVER () AS r, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
  || (CASE WHEN f < t.doc_id THEN 'E' ELSE '' END) AS fails
  FROM t JOIN firsts USING (text) LEFT JOIN l ON l.doc_id = t.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND a.x <> e.x AND b.x <> c.x AND b.x <> d.x AND b.x <> e.x AND c.x <> d.x AND c.x <> e.x AND d.x <> e.x),
steps AS (SELECT filter_order, s AS step, substr(filter_order, s, 1) AS f FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
kinds AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, fails),
gone AS (SELECT part, filter_order, fails, n, good, toxic, length(regexp_extract(filter_order, CASE WHEN fails = '' THEN '$.' ELSE '^[^' || fails || ']*[' || fails || ']' END)) AS gone_at FROM kinds, orders),
counts AS (SELECT g.part, s.filter_order, s.step, s.f, sum(CASE WHEN gone_at = 0 OR gone_at > s.step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone_at = s.step THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN contains(fails, s.f) AND gone_at < s.step THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = s.f THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN gone_at = s.step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone_at = s.step THEN toxic ELSE 0 END) AS toxic_lost
  FROM gone g JOIN steps s ON g.filter_order = s.filter_order GROUP BY g.part, s.filter_order, s.step, s.f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counts
"""
