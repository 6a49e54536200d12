import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tickloom.llm import bpe, chunks, token_counts, token_files
from tickloom.llm.queries import QUERIES
from tickloom.llm.vocabulary import default_path, vocabulary

from .conftest import EDGE_TEXTS, documents

SF = "/root/testdata/sf0.001"
PATH = default_path()
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def raw(values):
    return np.array(values, "<u4").tobytes()


def odd_texts():
    draw = random.Random(7)
    letters = "ab e'sthLl \n \t.,1🙂é  "
    texts = ["", " ", "a ", "  a", "a  b", " \n x\n\n", "a" * 500, "<|endoftext|>", "a  <|endoftext|> b<|endoftext|><|endoftext|>", "don't I'LL 's", "日本語 1234", "\x1c \x1f a", " \x1c\x1f  b", "a\n b \n c "]
    return texts + ["".join(draw.choice(letters) for _ in range(draw.randint(0, 80))) for _ in range(1500)]


@pytest.mark.parametrize("encoder", [bpe.encoder, token_files.library_encoder])
def test_ids_are_the_library_s(encoder):
    texts = odd_texts()
    flat, n = chunks.ids_of(pa.array(texts), encoder(PATH), vocabulary(PATH).special)
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [ids(t) for t in texts]


def test_counts_are_the_library_s():
    texts = odd_texts()
    assert chunks.counts_of(pa.array(texts), token_counts.counter(PATH), list(vocabulary(PATH).special)).tolist() == [len(ids(t)) for t in texts]


def test_every_code_point():
    """Alone, before a contraction, after letters, digits and a space: ids and counts as the library's, whose Unicode decides."""
    points = [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE0200), 0xF0000, 0x10FFFF))]
    texts = ["\n".join(f"{c}'s a{c} 1{c}2 {c}\n{c}" for c in points[i : i + 200]) for i in range(0, len(points), 200)]
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    for encoder in (bpe.encoder, token_files.library_encoder):
        flat, n = chunks.ids_of(pa.array(texts), encoder(PATH), vocabulary(PATH).special)
        got = np.split(flat, np.cumsum(n)[:-1])
        assert all(g.tolist() == w for g, w in zip(got, want, strict=True))
    assert chunks.counts_of(pa.array(texts), token_counts.counter(PATH), list(vocabulary(PATH).special)).tolist() == list(map(len, want))


@pytest.mark.parametrize("codec", [lambda docs: bpe.decode(bpe.encode(docs, PATH), PATH), lambda docs: bpe.round_trip(docs, PATH)])
def test_codec_edge_cases(spark, codec):
    found = codec(documents(spark, EDGE_TEXTS)).collect()
    assert sorted((str(r.doc_id), bytes(r.ids), r.text) for r in found) == sorted((str(i), raw(ids(t)), LIBRARY.decode(ids(t), skip_special_tokens=False)) for i, t in EDGE_TEXTS)
    assert codec(documents(spark, [])).count() == 0


def test_codec_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted((r.doc_id, len(ids(r.text)), hashlib.sha256(raw(ids(r.text))).hexdigest(), hashlib.sha256(LIBRARY.decode(ids(r.text), skip_special_tokens=False).encode()).hexdigest()) for r in rows)
    assert sorted(map(tuple, QUERIES["op3_bpe_codec"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == want


def test_counts_edge_cases_and_query(spark):
    found = token_counts.count_tokens(documents(spark, EDGE_TEXTS), PATH).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in found) == sorted((str(i), len((t or "").encode()), len(ids(t))) for i, t in EDGE_TEXTS)
    assert token_counts.count_tokens(documents(spark, []), PATH).count() == 0
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted((r.doc_id, len(r.text.encode()), len(ids(r.text)), len(ids(r.text)) > 512) for r in rows)
    assert sorted(map(tuple, QUERIES["op10_token_counts"](spark, SF).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())) == want


def test_code_lengths_are_optimal_and_limited():
    import heapq

    draw = np.random.default_rng(3)
    for size in (1, 2, 3, 50, 300):
        counts = draw.integers(0, 1000, size)  # so even that the limit on lengths is not reached
        counts[0] = 1
        n = token_files.code_lengths(counts)
        assert ((n > 0) == (counts > 0)).all()
        heap, cost = sorted(counts[counts > 0].tolist()), 0
        while len(heap) > 1:  # Huffman's cost is the sum of all merged weights
            x = heapq.heappop(heap) + heapq.heappop(heap)
            cost += x
            heapq.heappush(heap, x)
        assert size <= 1 or (n * counts).sum() == cost
    n = token_files.code_lengths(2 ** np.arange(40))
    assert n.max() <= token_files.LONGEST and (0.5 ** n).sum() == 1


def plain_files(rows, end=2):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.array([*ids(r[1]), end], "<u2").tobytes())):
        x = [*ids(t), end]
        out.append((str(i), start, len(x), zlib.crc32(raw(x))))
        start += len(x)
    return out


def test_token_files_edge_cases(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 50)
    for name, rows in (("some", EDGE_TEXTS), ("none", [])):
        target = f"file://{tmp_path}/{name}"
        token_files.write_tokens(documents(spark, rows), target, PATH, 2)
        found = token_files.read_tokens(spark, target).collect()
        assert sorted(((str(r.doc_id), r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in found), key=lambda r: r[1]) == plain_files(rows)


def test_token_files_of_hot_ids(spark, tmp_path, monkeypatch):
    """Documents that share an id, or have none, are spread over buckets of about equal size, in order."""
    monkeypatch.setattr(token_files, "LEAST_BYTES", 200)
    monkeypatch.setattr(token_files, "BUCKET_BYTES", 2_000)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} of many {i * i}") for i in range(3000)]
    target = f"file://{tmp_path}/hot"
    token_files.write_tokens(documents(spark, rows), target, PATH, 2)
    found = token_files.read_tokens(spark, target).collect()
    assert sorted(((str(r.doc_id), r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in found), key=lambda r: r[1]) == plain_files(rows)
    sizes = [r["count"] for r in spark.read.parquet(f"{target}/blocks").selectExpr("bucket", "explode(docs)").groupBy("bucket").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 4 * len(rows) / len(sizes)


def test_token_files_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = QUERIES["op8_token_files"](spark, SF).collect()
    assert sorted(((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in found), key=lambda r: r[1]) == plain_files(rows)


def test_token_files_encoder_remembers_its_words():
    """Chunks beyond the first 100,000 are known too when they come again."""
    from tickloom.llm.token_files import library_encoder
    from tickloom.llm.vocabulary import default_path

    encoder, asked = library_encoder.__wrapped__(default_path()), []
    plain = encoder.encode
    encoder.encode = lambda units: asked.append(len(units)) or plain(units)
    units = [f" {i}" for i in range(120_000)]
    assert encoder(units) == encoder(units) and asked == [120_000]
