"""Token ids in files: canonical length-limited Huffman codes, in independent blocks with bit-offset checkpoints.

The ids of all documents, in ascending order of document, are cut into buckets of about BUCKET_BYTES by ranges of the
document id (and of the first ids of a document, so that one id with very many documents is split as well), and within a
bucket into blocks of whole documents. A block holds its documents' ids as one bit stream under the code that the
global counts give, with the bit offset of every EVERY-th id. Blocks decode on their own, and within a block the stretches
between checkpoints are decoded side by side, by one table look-up for each id. On disk the format is a folder:

    blocks/   Parquet: bucket, first id's position in it, document ids, lengths, bits, checkpoints
    buckets/  Parquet: for each bucket the ids of all buckets before it
    code/     Parquet: each id that occurs and the length of its code; canonical codes follow from these
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import binary
from .chunks import Remembering, freed, ids_of, slices
from .common import new_dir
from .vocabulary import byte_letters, vocabulary

LONGEST = 18
BLOCK_IDS = 1 << 18
EVERY = 128
#: Bytes of ids that a bucket should hold, the least of them for the sake of more tasks, and bytes of a document that order it.
BUCKET_BYTES, LEAST_BYTES, ORDERED = 64 << 20, 2 << 20, 64
#: Pre-tokens, and chunks with their spaces and punctuation, that a worker remembers: some 100 bytes each.
REMEMBERED_WORDS, REMEMBERED_CHUNKS = 500_000, 300_000
BLOCK = "bucket int, start long, docs array<long>, lengths array<long>, bits binary, checkpoints binary"


@cache
def library_encoder(path: str) -> Remembering:
    """The tokenizers library's own BPE model, asked for one pre-token at a time, each once while remembered."""
    from tokenizers import Tokenizer

    vocab, tokenizer = vocabulary(path), Tokenizer.from_file(path)
    model, letters, known = tokenizer.model, dict(enumerate(byte_letters())), {}
    words, get = vocab.words, known.get

    def units(units: list[str]) -> list[bytes]:
        out = []
        for u in units:
            ids = b""
            for w in words(u):
                x = get(w)
                if x is None:
                    x = array("I", [t.id for t in model.tokenize(w if w.isascii() and w.isalpha() else w.encode().decode("latin-1").translate(letters))]).tobytes()
                    if len(known) < REMEMBERED_WORDS:
                        known[w] = x
                ids += x
            out.append(ids)
        return out

    return Remembering(units, REMEMBERED_CHUNKS)


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """The lengths of an optimal prefix code of at most ``longest`` bits for symbols with the given counts (0: no code)."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    assert n <= 1 << longest
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    # package-merge: at each level the symbols and the pairs of the level before, in order of weight
    levels, merged = [np.ones(n, bool)], weights
    for _ in range(longest - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weights, pairs))
        order = np.argsort(both, kind="stable")
        levels.append(order < n)
        merged = both[order]
    take = 2 * n - 2
    for is_symbol in reversed(levels):
        symbols = int(is_symbol[:take].sum())
        lengths[used[:symbols]] += 1
        take = 2 * (take - symbols)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: in order of length, then of symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        if n := int(lengths[s]):
            code <<= n - before
            codes[s] = code
            code, before = code + 1, n
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """The bit stream, the bit offsets of every EVERY-th id, and the number of bits."""
    n = lengths[ids]
    ends = np.cumsum(n)
    starts = ends - n
    bits = int(ends[-1]) if len(ids) else 0
    word = starts >> 5
    shifted = codes[ids] << (64 - (starts & 31) - n).astype(np.uint64)
    size = (bits >> 5) + 2
    # the bits of a word are disjoint, and sums below 2^53 are exact
    total = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), size) + np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    return total.astype(np.uint64).astype(">u4").tobytes(), starts[::EVERY], bits


def decode_table(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all LONGEST-bit prefixes the symbol and the length of its code."""
    symbol, size = np.zeros(1 << LONGEST, np.uint32), np.ones(1 << LONGEST, np.uint8)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (LONGEST - lengths[used])
    assert not len(used) or int(codes[used[0]]) == 0
    symbol[: spans.sum()] = np.repeat(used, spans)
    size[: spans.sum()] = np.repeat(lengths[used], spans)
    return symbol, size


def unpack(streams: list[bytes], checkpoints: list[np.ndarray], counts: list[int], table: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The ids of each stream; all stretches between checkpoints step forward together."""
    symbol, size = table
    sizes = [len(s) // 4 for s in streams]
    words = np.concatenate([np.frombuffer(b"".join(streams), ">u4"), np.zeros(1 + EVERY, ">u4")]).astype(np.uint64)
    base = np.repeat((np.cumsum(sizes) - sizes) * 32, [len(c) for c in checkpoints])
    at = base + np.concatenate(checkpoints).astype(np.int64)
    out = np.empty((EVERY, len(at)), np.uint32)
    last = len(words) - 2
    for k in range(EVERY):
        w = np.minimum(at >> 5, last)
        prefix = ((words[w] << np.uint64(32) | words[w + 1]) >> (64 - LONGEST - (at & 31)).astype(np.uint64)) & np.uint64((1 << LONGEST) - 1)
        out[k] = symbol[prefix]
        at = at + size[prefix]
    flat, result, lane = out.T.reshape(-1), [], 0
    for n, c in zip(counts, checkpoints, strict=True):
        result.append(flat[lane * EVERY : lane * EVERY + n])
        lane += len(c)
    return result


def write_tokens(docs: DataFrame, target: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole texts, appends ``end_id`` to each, and writes the files under ``target``.

    Null texts count as empty, null ids come first, equal ids in order of their tokens; repeated rows are documents of
    their own; other columns are left behind. An empty table gives empty tables.
    """
    spark = docs.sparkSession
    size = len(vocabulary(path).bytes)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    item = np.dtype(kind).itemsize

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = vocabulary(path).special
        for batch in freed(batches):
            for part, texts in slices(batch, "text"):
                ids, n = ids_of(texts, library_encoder(path), special)
                ids = np.insert(ids, np.cumsum(n), end_id)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n + 1, pa.int64()), binary(ids.astype(kind).tobytes(), (n + 1) * item)], names=["id", "n", "ids"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    store = new_dir(spark, "tokens")
    plain.mapInArrow(encode, "id long, n long, ids binary").write.option("compression", "zstd").parquet(store)
    tokens = spark.read.schema("id long, n long, ids binary").parquet(store)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in freed(batches):
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "count"])

    counts = np.zeros(size, np.int64)  # as long as the vocabulary
    for row in tokens.select("ids").mapInArrow(count, "id int, count long").groupBy("id").agg(F.sum("count").alias("count")).collect():
        counts[row["id"]] = row["count"]
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, length int").coalesce(1).write.parquet(f"{target}/code")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task has a bucket, in order."""
        bucket, at = TaskContext.get().partitionId(), 0
        for batch in freed(batches):
            n = batch.column(1).to_numpy()
            # a batch's end, and enough ids, close a block
            edges = np.flatnonzero(np.diff(np.cumsum(n) // BLOCK_IDS, prepend=-1)).tolist()
            for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                rows = batch.slice(a, b - a)
                bits, marks, _ = pack(np.frombuffer(b"".join(rows.column(2).to_pylist()), kind), codes, lengths)
                values = [[bucket], [at], [rows.column(0).to_pylist()], [n[a:b].tolist()], [bits], [marks.astype("<u4").tobytes()]]
                at += int(n[a:b].sum())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()), strict=True)], names=["bucket", "start", "docs", "lengths", "bits", "checkpoints"])

    n_bytes = int(counts.sum()) * item
    buckets = max(-(-n_bytes // BUCKET_BYTES), min(2 * spark.sparkContext.defaultParallelism, -(-n_bytes // LEAST_BYTES)), 1)
    placed = tokens.repartitionByRange(buckets, "id", F.substring("ids", 1, ORDERED)).sortWithinPartitions("id", "ids")
    placed.mapInArrow(block, BLOCK).write.option("compression", "none").parquet(f"{target}/blocks")
    # as many as there are partitions, which may be more than were asked for
    found = {row["bucket"]: row["n"] for row in spark.read.schema(BLOCK).parquet(f"{target}/blocks").groupBy("bucket").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()}
    names = sorted(found)
    ends = np.cumsum([found[b] for b in names], dtype=np.int64)
    spark.createDataFrame([(b, int(end) - found[b]) for b, end in zip(names, ends, strict=True)], "bucket int, base long").coalesce(1).write.parquet(f"{target}/buckets")


def read_tokens(spark: SparkSession, target: str, id_col: str = "doc_id") -> DataFrame:
    """Reads the files back: ``id_col``, start, n_tokens (long), and ids as little-endian unsigned 32-bit integers."""
    lengths = np.zeros(0, np.int64)
    for row in spark.read.schema("id int, length int").parquet(f"{target}/code").collect():  # as long as the vocabulary
        if row["id"] >= len(lengths):
            lengths = np.concatenate((lengths, np.zeros(row["id"] + 1 - len(lengths), np.int64)))
        lengths[row["id"]] = row["length"]
    tables: list = []
    base = {row["bucket"]: row["base"] for row in spark.read.schema("bucket int, base long").parquet(f"{target}/buckets").collect()}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tables:
            tables.append(decode_table(lengths, canonical(lengths)))
        for batch in freed(batches):
            for at in range(0, batch.num_rows, 8):
                rows = batch.slice(at, 8)
                bucket, start, docs, sizes, bits, marks = (rows.column(i).to_pylist() for i in range(6))
                ids = unpack(bits, [np.frombuffer(m, "<u4") for m in marks], [sum(s) for s in sizes], tables[0])
                for of, first, names, size, flat in zip(bucket, start, docs, sizes, ids, strict=True):
                    n = np.array(size, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(base[of] + first + np.cumsum(n) - n), pa.array(n), binary(flat.astype("<u4").tobytes(), n * 4)], names=["id", "start", "n_tokens", "ids"])

    blocks = spark.read.schema(BLOCK).parquet(f"{target}/blocks")
    return blocks.mapInArrow(decode, "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)
