"""SimHash near-duplicates by anchor-point covering.

Anchors are the codewords of two perfect binary Golay codes [23, 12], over bits 0-22 and 23-45 of the fingerprint: every
fingerprint lies within 3 bits of exactly one codeword in either half, its home anchor, so the covering radius is 3 and 3.
If two fingerprints differ in at most 2 bits, the second lies within the radius plus 2 of the first one's home, the 2
shared between the halves. Every distinct fingerprint is therefore replicated to all such anchors (62 on average), and at
each anchor the fingerprints at home are compared, over all 64 bits, with all that came. An anchor gives the forest of
its links, not its pairs.

A large group of near copies can crowd an anchor. Where more than CROWDED fingerprints are at home, all that came are
compared with the finest code instead, whose anchors are all words: fingerprints 2 bits apart share a word at 1 bit from
both, and no more than 65 fingerprints are that close to one word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import freed, slices
from .common import saved, temporary
from .components import components

BITS = 64
LANES = np.uint64(0x0101010101010101)
#: Fixed value: generator polynomial of the binary Golay code [23, 12, 7].
GOLAY = 0b110001110101
WIDTH, CHECKS = 23, 11
LOW = np.uint64((1 << WIDTH) - 1)
CROWDED = 1024
BLOCK_ROWS, BLOCK_PAIRS = 400_000, 2_000_000


def digests(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42, uint64) of all shingles of ``size`` words of lower-cased texts, text by text, and each text's number."""
    from xxhash import xxh64_intdigest as digest

    hashes, counts = [], []
    for text in texts:
        words = text.split()
        n = max(1, len(words) - size + 1) if words else 0
        counts.append(n)
        if n == 1:
            hashes.append(digest(b" ".join(words), 42))
        elif n:
            line = b" ".join(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lengths + 1) - 1
            hashes += [digest(line[a:b], 42) for a, b in zip((ends - lengths)[:n].tolist(), ends[size - 1 :].tolist(), strict=True)]
    return np.array(hashes, np.uint64), np.array(counts, np.int64)


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprints (uint64) of texts with ``counts`` hashes each: the bits that more than half of them have."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    # eight counters of a byte each in a word hold up to 255 hashes: runs of 255, then the runs of a text together
    n = counts[some]
    runs = -(-n // 255)
    of = np.repeat(np.arange(len(some)), runs)
    first = np.cumsum(runs) - runs
    starts = (np.cumsum(n) - n)[of] + 255 * (np.arange(len(of)) - first[of])
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & LANES, starts).view(np.uint8).reshape(-1, 8)
        over = 2 * np.add.reduceat(lanes, first, axis=0, dtype=np.int64) > n[:, None]
        for lane in range(8):
            out[some] |= over[:, lane].astype(np.uint64) << np.uint64(8 * lane + k)
    return out


def simhash(texts: list[bytes], size: int = 3) -> np.ndarray:
    """The fingerprints (uint64) of lower-cased texts: majority bits of XXH64 (seed 42) over shingles of ``size`` words."""
    return majority(*digests(texts, size))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """Returns ``id_col`` and ``fp`` (long) of each whole text; no words, or a null text: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for part, texts in slices(batch, "text"):
                fp = simhash(pc.ascii_lower(texts).cast(pa.binary()).to_pylist(), size)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainders of 23-bit words by the generator polynomial."""
    out = words.astype(np.int64)
    for bit in range(WIDTH - 1, CHECKS - 1, -1):
        out = np.where(out >> bit & 1, out ^ (GOLAY << (bit - CHECKS)), out)
    return out


@cache
def patterns() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the distances up to 3, 4, and 5: error patterns in order of their syndrome, and each syndrome's first and number."""
    out = []
    for weights in (range(4), (4,), (5,)):
        errors = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(WIDTH), w)], np.int64)
        of = syndrome(errors)
        order = np.argsort(of, kind="stable")
        counts = np.bincount(of, minlength=1 << CHECKS)
        out.append((errors[order], np.cumsum(counts) - counts, counts))
    assert (out[0][2] == 1).all()  # perfect: one codeword within 3 of each word
    return out


def replicate(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (anchor, fingerprint, at home) of all anchors within the covering radius plus 2."""
    halves = [(fp & LOW).astype(np.int64), (fp >> np.uint64(WIDTH) & LOW).astype(np.int64)]
    remainders = [syndrome(h) for h in halves]
    anchors, of, home = [], [], []
    for a, b in ((0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (2, 0)):
        (ea, fa, ca), (eb, fb, cb) = patterns()[a], patterns()[b]
        na, nb = ca[remainders[0]], cb[remainders[1]]
        each = na * nb
        i = np.repeat(np.arange(len(fp)), each)
        k = np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each)
        x = halves[0][i] ^ ea[fa[remainders[0][i]] + k // nb[i]]
        y = halves[1][i] ^ eb[fb[remainders[1][i]] + k % nb[i]]
        anchors.append((x >> CHECKS) << (WIDTH - CHECKS) | y >> CHECKS)
        of.append(i)
        home.append(np.full(len(i), a == b == 0))
    return np.concatenate(anchors), fp[np.concatenate(of)], np.concatenate(home)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (node, least node of its component) that say the same as the pairs a, b."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        for at in (u, v, label[u], label[v]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def compare(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Links of whole anchors, whose rows lie together with those at home first; or the rows of crowded anchors."""
    starts = np.flatnonzero(np.diff(anchor, prepend=-1))
    rows = np.diff(np.append(starts, len(anchor)))
    homes = np.add.reduceat(home.astype(np.int64), starts)
    for s, n in zip(starts[homes > CROWDED], rows[homes > CROWDED], strict=True):
        yield fp[s : s + n], fp[s : s + n], True
    small = (homes > 0) & (rows > 1) & (homes <= CROWDED)
    starts, rows, homes = starts[small], rows[small], homes[small]
    owner = np.repeat(starts, homes) + np.arange(homes.sum()) - np.repeat(np.cumsum(homes) - homes, homes)
    end = np.repeat(starts + rows, homes)
    each = end - owner - 1  # a home is compared with what follows it
    upto = np.cumsum(each)
    at = 0
    while at < len(owner):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK_PAIRS, side="right")))
        n = each[at:to]
        i = np.repeat(owner[at:to], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        near = np.bitwise_count(fp[i] ^ fp[j]) <= most
        if near.any():
            yield *forest(fp[i[near]], fp[j[near]]), False
        at = to


def compare_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """compare() over a partition in order of (anchor, home first); an anchor with very many rows goes through in parts."""
    kept: list[np.ndarray] = []

    def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows):
            for a, b, crowded in compare(rows["anchor"], rows["fp"].view(np.uint64), rows["home"], 2):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), crowded))], names=["u", "v", "crowded"])

    for batch in freed(batches):
        rows = np.empty(batch.num_rows, [("anchor", np.int64), ("fp", np.int64), ("home", bool)])
        for name in ("anchor", "fp", "home"):
            rows[name] = batch.column(batch.schema.names.index(name)).to_numpy(zero_copy_only=False)
        kept.append(rows)
        if sum(map(len, kept)) >= BLOCK_ROWS:
            rows = np.concatenate(kept)
            last = rows["anchor"] == rows["anchor"][-1]
            if last.all():  # one anchor only: its homes stay for the rows that follow
                yield from out(rows)
                kept = [rows[rows["home"]][: CROWDED + 1]]
            else:
                yield from out(rows[~last])
                kept = [rows[last]]
    if kept:
        yield from out(np.concatenate(kept))


def links(prints: DataFrame) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints ``fp`` just as all pairs at 2 or fewer differing bits do."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for at in range(0, batch.num_rows, 2000):
                fp = batch.column(0).slice(at, 2000).to_numpy(zero_copy_only=False).view(np.uint64)
                anchor, fp, home = replicate(fp)
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int32()), pa.array(fp.view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    rows = prints.select("fp").mapInArrow(spread, "anchor int, fp long, home boolean")
    ordered = rows.repartition("anchor").sortWithinPartitions("anchor", F.desc("home"))
    found = saved(ordered.mapInArrow(compare_sorted, "u long, v long, crowded boolean"), "links")
    crowd = found.where("crowded").select(F.col("u").alias("fp")).distinct()
    words = crowd.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(BITS)))).alias("word"))
    shared = words.groupBy("word").agg(F.collect_list("fp").alias("near")).where("size(near) > 1").select(F.array_min("near").alias("u"), F.explode("near").alias("v"))
    return found.where("not crowded").select("u", "v").union(shared.where("u <> v").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """Returns ``id_col``, ``fp`` (long) and ``component_id``: the smallest id whose fingerprint is reachable by links.

    Null and empty texts have fingerprint zero, linked like any other; rows with a null id take part and get the smallest
    id that isn't null (null if there is none); repeated rows each give a row. Other columns are left behind. An empty
    table gives no rows.
    """
    with temporary(docs.sparkSession):
        prints = saved(fingerprints(docs, id_col, text_col, size), "fingerprints")
        nodes = saved(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
        roots = saved(components(links(nodes)), "roots")
        rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        found = prints.join(rooted.select("fp", "root").join(ids, "root").select("fp", "component_id"), "fp")
        return saved(found.select(id_col, "fp", "component_id"), "near-duplicates", keep=True)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each group of near duplicates, with all their columns.

    Rows with one id are one document: one of them stays. Rows with a null id can't be told apart and stay.
    """
    found = near_duplicates(docs, id_col, text_col, size).where(F.col(id_col).isNotNull())
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    kept = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    if found.groupBy(id_col).count().where("count > 1").isEmpty():
        return kept
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(kept.where(F.col(id_col).isNull()))
