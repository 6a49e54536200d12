"""SimHash near-dedup at a stated similarity: links by anchor covering, confirmed and completed on the shingles themselves.

A text is the set of its distinct shingles' XXH64 hashes; texts with equal sets are one node. Two nodes are linked if their
Jaccard similarity is the threshold or more. Fingerprints within 2 bits (simhash.links) give the first candidates; but pairs
at a similarity of 0.8 are often 4 to 17 bits apart, beyond what any covering of 64 bits can find without comparing most of
all pairs. Prefixes find the others, and lose none: in any one order of all shingles, two sets of similarity t or more share
one of the first n - ceil(t * n) + 1 of either. The order is shingles by hash, with those that a sample of texts holds often
at the end, the most frequent last: a line that many texts have is then in few prefixes. The sample changes what is
compared, not what is found.

A large group of near copies would give all its pairs. So, first, the nodes of a shingle are paired with two of them (others
for each shingle), and of these pairs and those of the fingerprints one is confirmed for each node, then those which that leaves
in different components; then only nodes which all this leaves in different components meet, in blocks; blocks of one
component don't meet each other. Before a pair costs anything it is judged by sketches: a set's sketch has the parities of BITS
counters, so two sketches differ in no more bits than the sets differ in shingles, and too many bits rule a pair out for
certain. What the sketches leave is compared on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import freed, slices
from .common import saved, temporary
from .components import components
from .simhash import digests, links, majority

#: Texts in the sample, the number of them that makes a shingle frequent, and frequent shingles that are kept at most.
SAMPLE, OFTEN, MOST = 20_000, 3, 200_000
#: Shingles of more than this share of the sample are spread over tasks from the start.
HOT = 0.01
#: Bits of a sketch at least (long sets have more; where many nodes meet they are folded to these), and sketches of this width
#: that are made together.
BITS, SKETCHED = 1024, 1000
#: Nodes of a shingle that meet in one block, rows that a task holds at once, and pairs of sketches.
BLOCK, BLOCK_ROWS, BLOCK_PAIRS = 4096, 200_000, 200_000
#: Sets that are compared with one node's set in one task (about: they are dealt by hash).
PART_SETS = 256
#: Texts of so many candidates at most are picked by a broadcast of their hashes (32 bytes each).
BROADCAST_ROWS = 500_000


def node(tokens: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(tokens.tobytes(), 7) - (1 << 63)


def sets_in(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Slices of rows with each text's distinct shingles, sorted, and all its shingles with their numbers."""
    for batch in freed(batches):
        for part, texts in slices(batch, "text"):
            h, n = digests(pc.ascii_lower(texts).cast(pa.binary()).to_pylist(), size)
            ends = np.cumsum(n)
            yield part, [np.unique(h[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)], h, n


def sketches(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sketch of each set: BITS bits, or as many (a power of two) as twice its shingles, as uint64."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(sets)
    of_width: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        of_width.setdefault(max(BITS, 1 << (2 * len(s) - 1).bit_length()), []).append(i)
    for width, those in of_width.items():
        step = max(1, SKETCHED * BITS // width)
        for at in range(0, len(those), step):
            some = those[at : at + step]
            of = np.repeat(np.arange(len(some)) * width, [len(sets[i]) for i in some])
            counts = np.bincount(of + (np.concatenate([sets[i] for i in some]) % np.uint64(width)).astype(np.int64), minlength=len(some) * width)
            for i, bits in zip(some, np.packbits((counts & 1).astype(bool)).view(np.uint64).reshape(-1, width // 64), strict=True):
                out[i] = bits
    return out


def folded(bits: np.ndarray, words: int = BITS // 64) -> np.ndarray:
    """The sketch of the same set with fewer bits: halves fall together."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def prefix(s: np.ndarray, threshold: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first tokens of a sorted set in the order: those that aren't common by hash, then the common by rank."""
    keep = len(s) - int(np.ceil(threshold * len(s) - 1e-9)) + 1
    if not len(common):
        return s[:keep]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    often = common[at] == s
    rare = s[~often][:keep]
    return rare if len(rare) == keep else np.concatenate((rare, s[often][np.argsort(rank[at[often]])][: keep - len(rare)]))


def frequent(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (sorted) that OFTEN or more sets of the sample hold (copies in several tasks count anew), their places in the
    order, and the hot ones (sorted)."""
    step = max(1, -(-texts.count() // SAMPLE))
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets, _, _ in sets_in(batches, size):
            fresh = [s for s in sets if len(s) and (k := node(s)) not in seen and not seen.add(k)]
            if fresh:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(fresh).view(np.int64))], names=["token"])

    counts = sample.mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") >= OFTEN)
    rows = counts.orderBy(F.desc("count"), "token").limit(MOST).toArrow()
    token, count = rows.column("token").to_numpy().view(np.uint64), rows.column("count").to_numpy()
    order = np.argsort(token)
    hot = count >= max(HOT * SAMPLE, OFTEN)
    return token[order], (len(token) - np.arange(len(token)))[order], np.sort(token[hot])


def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (token, h, node), those whose token another node has too, each once, with the first two nodes
    (a, b) of the token. A token's rows go through in parts, however many there are."""
    kind = [("token", np.int64), ("node", np.int64)]
    kept = np.empty(0, kind)
    head: tuple[int, int, int] | None = None  # token, first and second node, once there is a second

    def out(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (rows["token"], rows["node"], a, b)], names=["token", "node", "a", "b"])

    def whole(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows whose last token may go on, but has two nodes here or in ``head``, or ends."""
        nonlocal head
        new = np.append(True, (rows["token"][1:] != rows["token"][:-1]) | (rows["node"][1:] != rows["node"][:-1]))
        rows = rows[new]
        starts = np.flatnonzero(np.append(True, rows["token"][1:] != rows["token"][:-1]))
        sizes = np.diff(np.append(starts, len(rows)))
        a, b = rows["node"][starts].copy(), rows["node"][np.minimum(starts + 1, len(rows) - 1)].copy()
        enough = sizes > 1
        if head is not None and rows["token"][0] == head[0]:
            a[0], b[0], enough[0] = head[1], head[2], True
        head = (int(rows["token"][-1]), int(a[-1]), int(b[-1])) if enough[-1] else None
        stay = np.repeat(enough, sizes)
        if stay.any():
            yield out(rows[stay], np.repeat(a, sizes)[stay], np.repeat(b, sizes)[stay])

    for batch in freed(batches):
        rows = np.empty(batch.num_rows, kind)
        for name in ("token", "node"):
            rows[name] = batch.column(batch.schema.names.index(name)).to_numpy(zero_copy_only=False)
        rows = np.concatenate((kept, rows))
        if not len(rows):
            continue
        # the last token's rows wait, unless it is known to be shared
        last = rows["token"] == rows["token"][-1]
        if head is not None and head[0] == rows["token"][-1] or len(np.unique(rows["node"][last])) > 1:
            kept = rows[:0]
        else:
            kept, rows = rows[last][-1:], rows[~last]
        if len(rows):
            yield from whole(rows)
    if len(kept):
        yield from whole(kept)


def sizes_fit(n: Column | np.ndarray, m: Column | np.ndarray, threshold: float) -> Column | np.ndarray:
    """Whether sets of these sizes can be that similar."""
    return (n >= threshold * m - 1e-9) & (m >= threshold * n - 1e-9)


def most_bits(n: Column | np.ndarray, m: Column | np.ndarray, threshold: float) -> Column | np.ndarray:
    """The most shingles that sets of these sizes may differ in, at the threshold."""
    return (1 - threshold) / (1 + threshold) * (n + m) + 1e-9


def meet(threshold: float):
    """Pairs (u, v) that size and sketch allow, of nodes of one cell (token, lo, hi) with different roots and, where lo and
    hi are two blocks, of both of them; rows come in order of cell."""
    words = BITS // 64

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.append(True, (rows["token"][1:] != rows["token"][:-1]) | (rows["lo"][1:] != rows["lo"][:-1]) | (rows["hi"][1:] != rows["hi"][:-1])))
        ends = np.append(starts[1:], len(rows))
        each = np.repeat(ends, ends - starts) - np.arange(len(rows)) - 1
        upto, at = np.cumsum(each), 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK_PAIRS, side="right")))
            n = each[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            at = to
            fit = (rows["root"][i] != rows["root"][j]) & ((rows["lo"][i] == rows["hi"][i]) | (rows["block"][i] != rows["block"][j])) & sizes_fit(rows["n"][i], rows["n"][j], threshold)
            i, j = i[fit], j[fit]
            apart = np.bitwise_count(rows["bits"][i] ^ rows["bits"][j]).sum(axis=1, dtype=np.int64)
            near = apart <= most_bits(rows["n"][i], rows["n"][j], threshold)
            if near.any():
                a, b = rows["node"][i[near]], rows["node"][j[near]]
                u, v = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("token", "lo", "hi", "block", "node", "root", "n")
        kept: list[np.ndarray] = []
        for batch in freed(batches):
            rows = np.empty(batch.num_rows, [*((c, np.int64) for c in names), ("bits", np.uint64, (words,))])
            for c in names:
                rows[c] = batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False)
            rows["bits"] = batch.column(batch.schema.names.index("bits")).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words)
            kept.append(rows)
            if sum(map(len, kept)) >= BLOCK_ROWS:
                rows = np.concatenate(kept)
                last = (rows["token"] == rows["token"][-1]) & (rows["lo"] == rows["lo"][-1]) & (rows["hi"] == rows["hi"][-1])
                yield from pairs(rows[~last])
                kept = [rows[last]]
        if kept and len(kept[0]):
            yield from pairs(np.concatenate(kept))

    return run


def in_parts(pairs: DataFrame) -> DataFrame:
    """The sets that each (u, part) compares, as (u, part, v): the v of its pairs, and u itself."""
    many = pairs.groupBy("u").agg(F.ceil(F.count("*") / PART_SETS).alias("parts")).where("parts > 1")
    parted = pairs.join(many, "u", "left").select("u", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1).cast("long"))).alias("part"), "v")
    return parted.union(parted.select("u", "part", F.col("u").alias("v")).distinct())


def blocks_meet(rooted: DataFrame) -> DataFrame:
    """Of (token, node, root), the nodes of tokens with more than three nodes and more than one root, once for each cell
    (token, lo, hi) of two blocks, as (token, lo, hi, block, node, root).

    A token's nodes of a root with more than BLOCK of them are blocks of that root alone, numbered from 1 on, which don't
    meet each other; the other nodes are mixed blocks (number 0) and meet all. A block is its number * 2^32 + its piece.
    So a few outsiders of a large component cost as many cells as it has blocks, not the square of that.
    """
    shift = lambda no, piece: F.shiftleft(no.cast("long"), 32) + piece
    tokens = saved(rooted.groupBy("token").agg(F.min("root").alias("first"), F.max("root").alias("last"), F.count("*").alias("k")).where("first <> last and k > 3").select("token", "k"), "tokens")
    counts = rooted.join(tokens.where(F.col("k") > BLOCK).select("token"), "token").groupBy("token", "root").agg(F.count("*").alias("k")).where(F.col("k") > BLOCK)
    large = saved(counts.select("token", "root", "k", F.row_number().over(Window.partitionBy("token").orderBy("root")).alias("no"), F.ceil(F.col("k") / BLOCK).alias("pieces")), "large")
    mixed = tokens.join(large.groupBy("token").agg(F.sum("k").alias("in_large")), "token", "left").select("token", F.ceil((F.col("k") - F.coalesce("in_large", F.lit(0))) / BLOCK).alias("mixed"))
    others = mixed.where("mixed > 0").select("token", F.lit(0).alias("other"), F.col("mixed").alias("others")).union(large.select("token", "no", "pieces"))
    of = rooted.join(mixed, "token").join(large.select("token", "root", "no", "pieces"), ["token", "root"], "left")
    placed = of.select("token", "node", "root", F.coalesce("no", F.lit(0)).alias("no"), F.pmod(F.xxhash64("node"), F.coalesce("pieces", "mixed")).alias("piece")).withColumn("block", shift(F.col("no"), F.col("piece")))
    met = placed.join(others, "token").where("no = 0 or no <> other").withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    other = shift(F.col("other"), F.col("with"))
    return met.select("token", F.least("block", other).alias("lo"), F.greatest("block", other).alias("hi"), "block", "node", "root")


def confirmed(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs (u, v) whose sets' similarity is the threshold or more, by the whole sets of one text for each node.

    The sets go to their u: its own comes first and stays, the others pass by, one at a time. A u with many others is cut
    into parts of about PART_SETS of them, each with a copy of u's own set, so a cluster's sets aren't one task's.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()  # of a task
        for rows, found, _, _ in sets_in(batches, size):
            centers, parts, names = (rows.column(i).to_pylist() for i in (1, 2, 3))
            fresh = [i for i, k in enumerate(zip(centers, parts, names, strict=True)) if k not in seen and not seen.add(k)]
            longs = [pa.array([x[i] for i in fresh], pa.int64()) for x in (centers, parts, names)]
            yield pa.RecordBatch.from_arrays([*longs, pa.array([names[i] != centers[i] for i in fresh], pa.bool_()), pa.array([found[i].view(np.int64) for i in fresh], pa.list_(pa.int64()))], names=["u", "part", "v", "other", "tokens"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, own, last = None, np.empty(0, np.int64), None
        for batch in freed(batches):
            us, parts, vs, others = (batch.column(i).to_pylist() for i in range(4))
            flat, ends = batch.column(4).flatten().to_numpy(zero_copy_only=False), np.cumsum(batch.column(4).value_lengths().to_numpy(zero_copy_only=False))
            out = []
            for i, (u, part, v, other) in enumerate(zip(us, parts, vs, others, strict=True)):
                tokens = flat[(ends[i - 1] if i else 0) : ends[i]]
                if not other:
                    center, own = (u, part), tokens
                elif center == (u, part) and (u, v) != last:
                    both = len(np.intersect1d(own, tokens, assume_unique=True))
                    if both >= threshold * (len(own) + len(tokens) - both) - 1e-9:
                        out.append((u, v))
                last = (u, v)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    wanted = saved(in_parts(pairs).join(nodes.select(F.col("node").alias("v"), "th"), "v").select("th", "u", "part", "v"), "wanted")
    picked = texts.withColumn("th", F.xxhash64("text")).join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "th").select("text", "u", "part", "v")
    rows = picked.mapInArrow(sets, "u long, part long, v long, other boolean, tokens array<long>").repartition("u", "part").sortWithinPartitions("u", "part", "other", "v")
    return saved(rows.mapInArrow(compare, "u long, v long"), "links")


def roots_of(links_: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(node, root) of the nodes that have links, of which those ``before`` led to are stars."""
    if before is not None:
        if links_.isEmpty():
            return before
        links_ = links_.union(before.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    return saved(components(links_), "roots")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """Returns ``id_col``, ``fp`` (long, the SimHash) and ``component_id``: the smallest id that links lead to.

    Null and empty texts are copies of each other; rows with a null id take part and get the smallest id that isn't null
    (null if there is none); repeated rows each give a row. An empty table gives no rows. Texts are compared whole.
    """
    texts = docs.select(F.col(text_col).alias("text"))
    common, rank, hot = frequent(texts, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, sets, h, n in sets_in(batches, size):
            names = [node(s) for s in sets]
            fresh = [i for i, (k, s) in enumerate(zip(names, sets, strict=True)) if len(s) and k not in seen and not seen.add(k)]
            rare, often, bits, wide = ([None] * len(sets) for _ in range(4))
            for i, b in zip(fresh, sketches([sets[i] for i in fresh]), strict=True):
                first = prefix(sets[i], threshold, common, rank)
                is_hot = np.isin(first, hot)
                rare[i], often[i], bits[i], wide[i] = first[~is_hot].view(np.int64), first[is_hot].view(np.int64), folded(b).view(np.int64), b.view(np.int64)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.int64()), pa.array(majority(h, n).view(np.int64)), pa.array(list(map(len, sets)), pa.int64()), part.column(2), pa.array(rare, longs), pa.array(often, longs), pa.array(bits, longs), pa.array(wide, longs)], names=["id", "node", "fp", "n", "th", "rare", "often", "bits", "wide"])

    def found() -> DataFrame:
        plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
        kind = plain.schema["id"].dataType.simpleString()
        prints = saved(plain.mapInArrow(run, f"id {kind}, node long, fp long, n long, th long, rare array<long>, often array<long>, bits array<long>, wide array<long>"), "prints")
        nodes = saved(prints.groupBy("node").agg(F.min("id").alias("least"), F.min("th").alias("th"), F.min("fp").alias("fp"), F.min("n").alias("n")), "nodes")
        sketched = saved(prints.where("bits is not null").select("node", "bits", "wide").dropDuplicates(["node"]), "sketches")

        def allowed(pairs: DataFrame) -> DataFrame:
            """The distinct pairs (node, v) that sizes and sketches allow, as (u, v)."""
            p = pairs.where(F.col("node") != F.col("v")).select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).distinct()
            p = p.join(nodes.select(F.col("node").alias("u"), F.col("n").alias("nu")), "u").join(nodes.select(F.col("node").alias("v"), F.col("n").alias("nv")), "v").where(sizes_fit(F.col("nu"), F.col("nv"), threshold))
            p = p.join(sketched.select(F.col("node").alias("u"), F.col("wide").alias("bu")), "u").join(sketched.select(F.col("node").alias("v"), F.col("wide").alias("bv")), "v")
            # sizes that fit differ by less than the half, and so do widths: one fold makes them equal
            half = lambda x: (F.size(x) / 2).cast("int")
            fold = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), lambda a, b: a.bitwiseXOR(b))
            p = p.withColumns({x: F.when(F.size(x) > F.size(y), fold(F.col(x))).otherwise(F.col(x)) for x, y in (("bu", "bv"), ("bv", "bu"))})
            apart = F.aggregate(F.zip_with("bu", "bv", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
            return p.where(apart <= most_bits(F.col("nu"), F.col("nv"), threshold)).select("u", "v")

        rows = prints.select(F.explode("rare").alias("token"), "node").withColumn("h", F.xxhash64("token", "node"))
        shared = rows.repartition("token").sortWithinPartitions("token", "h", "node").select("token", "node").mapInArrow(shared_only, "token long, node long, a long, b long")
        spread = prints.select(F.explode("often").alias("token"), "node").distinct().withColumn("h", F.xxhash64("token", "node"))
        ends = spread.groupBy("token").agg(F.min_by("node", "h").alias("a"), F.max_by("node", "h").alias("b"))
        shared = saved(shared.union(spread.join(ends, "token").select("token", "node", "a", "b")), "shared")

        heads = saved(nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("head")), "heads")
        one = nodes.where("n > 0").join(heads, "fp").select("node", F.col("head").alias("v"))
        other = links(heads.select("fp")).join(heads.select(F.col("fp").alias("u"), F.col("head").alias("node")), "u").join(heads.select(F.col("fp").alias("v"), F.col("head").alias("to")), "v").select("node", F.col("to").alias("v"))
        star = shared.select("node", F.explode(F.array("a", "b")).alias("v"))
        first = saved(allowed(one.union(other).union(star)), "candidates")
        # each node with the least of those it is paired with, then the pairs that this leaves in different components
        ends = first.union(first.select("v", "u"))
        least = ends.groupBy("u").agg(F.min("v").alias("w")).select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("v")).distinct()
        roots = roots_of(confirmed(least, texts, nodes, size, threshold))

        def apart(pairs: DataFrame) -> DataFrame:
            of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
            j = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
            return j.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v")

        others = saved(apart(first.join(least, ["u", "v"], "left_anti")), "candidates")
        roots = roots_of(confirmed(others, texts, nodes, size, threshold), roots)

        # shingles of up to three nodes have had all their pairs compared; where all nodes are one component there is no more to say
        rooted = saved(shared.select("token", "node").join(roots, "node", "left").select("token", "node", F.coalesce("root", "node").alias("root")), "rooted")
        cells = blocks_meet(rooted).join(nodes.select("node", "n"), "node").join(sketched.select("node", "bits"), "node").select("token", "lo", "hi", "block", "node", "root", "n", "bits")
        rest = cells.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi").mapInArrow(meet(threshold), "u long, v long").select(F.col("u").alias("node"), "v")
        roots = roots_of(confirmed(saved(allowed(rest).join(first, ["u", "v"], "left_anti"), "candidates"), texts, nodes, size, threshold), roots)
        of = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
        ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
        return prints.select("id", "fp", "node").join(of.select("node", "root").join(ids, "root").select("node", "component_id"), "node").select(F.col("id").alias(id_col), "fp", "component_id")

    with temporary(docs.sparkSession):
        return saved(found(), "near-copies", keep=True)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each group of near copies, with all their columns.

    Rows with one id are one document: one of them stays. Rows with a null id can't be told apart and stay.
    """
    found = near_copies(docs, id_col, text_col, size, threshold).where(F.col(id_col).isNotNull())
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    kept = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    if found.groupBy(id_col).count().where("count > 1").isEmpty():
        return kept
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(kept.where(F.col(id_col).isNull()))
