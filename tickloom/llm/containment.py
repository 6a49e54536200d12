"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles.

Items are partitioned by their number of distinct five-word shingles (powers of two). The MinHash sketch of an item is
its k least shingle hashes, with k set by its partition's greatest size u: k = floor((1 - threshold) * u) + 1. A document
with at least the threshold of an item's shingles lacks fewer than k of them, so it has one of the sketch: the search
loses nothing, however long the document. A document is a candidate for an item if it holds a hash of the sketch and is
large enough to hold the item at all; the candidates' shingles are then compared as strings.

Only DataFrame expressions; what is shuffled is candidates, and the texts of documents that are candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Sketches of so many hashes at most (16 bytes each) are broadcast; larger ones are joined by a shuffle of hashes.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), "")


def windows(column: str, size: int, make) -> Column:
    """``make(i)`` for each window of the words in ``column``; fewer words than ``size`` are one window, none have none."""
    n = F.size(column)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))), make


def hashes(column: str, size: int) -> Column:
    at, make = windows(column, size, lambda i: F.xxhash64(*(F.get(column, i + k) for k in range(size))))
    return F.array_distinct(F.transform(at, make))


def shingles(column: str, size: int) -> Column:
    at, make = windows(column, size, lambda i: F.concat_ws(" ", F.slice(F.col(column), i + 1, size)))
    return F.array_distinct(F.transform(at, make))


def sketches(items: DataFrame, size: int, threshold: float) -> DataFrame:
    """(h, item, needed): the least hashes of each item, and how many shingles a document needs to hold it."""
    sized = items.withColumn("hs", F.sort_array(hashes("words", size))).withColumn("q", F.size("hs")).where("q > 0")
    part = F.floor(F.log2(F.col("q")))  # the size partition; its greatest size is u
    u = F.pow(F.lit(2), part + 1) - 1
    k = F.least(F.col("q"), (F.floor((1 - threshold) * u + 1e-9) + 1).cast("int"))
    return sized.select("item", F.ceil(threshold * F.col("q") - 1e-9).alias("needed"), F.explode(F.slice(F.col("hs"), F.lit(1), k)).alias("h"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """Returns each pair of a document and an item of whose distinct shingles it holds the threshold or more:
    ``id_col``, ``item_col``, n_shared and n_shingles (long).

    Fewer words than ``size`` are one shingle; a text without words, or null, has none and is in no pair. Null ids are
    ids like others. Repeated rows give a pair once. Other columns are left behind; clashing names do no harm. Empty
    tables give no rows. Whole texts are searched.
    """
    tests = saved(items.select(F.col(item_col).alias("item"), words(F.col(item_text)).alias("words")), "items")
    sketch = saved(sketches(tests, size, threshold), "sketch")
    if sketch.count() <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)
    plain = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("words"))
    held = plain.select("id", hashes("words", size).alias("hs")).select("id", F.size("hs").alias("n"), F.explode_outer("hs").alias("h"))  # explode() would add a filter that computes hs anew for each use
    candidates = saved(held.join(sketch, "h").where("n >= needed").groupBy("id", "item").agg(F.lit(1).alias("one")).select(F.col("id").alias("of"), "item"), "candidates")
    wanted = candidates.groupBy("of").agg(F.collect_set("item").alias("list"), F.max(F.col("item").isNull()).alias("also_null"))
    texts = plain.join(wanted, F.col("id").eqNullSafe(F.col("of"))).withColumn("have", shingles("words", size))
    pairs = texts.select("id", "have", F.explode(F.when(F.col("also_null"), F.array_append("list", F.lit(None))).otherwise(F.col("list"))).alias("wants"))
    exact = tests.withColumn("has", shingles("words", size)).select("item", "has")
    found = pairs.join(exact, F.col("wants").eqNullSafe(F.col("item"))).select("id", "item", F.size(F.array_intersect("have", "has")).cast("long").alias("n_shared"), F.size("has").cast("long").alias("n_shingles"))
    return found.where(F.col("n_shared") >= threshold * F.col("n_shingles") - 1e-9).distinct().select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_shared", "n_shingles")


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """The rows of ``docs`` that contain none of ``items``, with all their columns; all rows of an id go together."""
    found = saved(contaminated(docs, items, id_col, **options).select(F.col(id_col)).distinct(), "contaminated")
    return docs.join(found, docs[id_col].eqNullSafe(found[id_col]), "left_anti")


ORACLE = r"""
WITH grams AS (
  SELECT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                          ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM (SELECT kind, id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
        FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark))),
items AS (SELECT DISTINCT id, g FROM grams WHERE kind = 'i'),
docs AS (SELECT DISTINCT id, g FROM grams WHERE kind = 'd'),
sizes AS (SELECT id, count(*) AS n FROM items GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, max(s.n) AS n_shingles
FROM docs d JOIN items i ON d.g = i.g JOIN sizes s ON s.id = i.id
GROUP BY d.id, i.id HAVING 5 * count(*) >= 4 * max(s.n)
"""
