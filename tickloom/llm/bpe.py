"""BPE encoding and decoding by dynamic programming over prefixes.

An automaton over the vocabulary finds, at each byte of a pre-token, every token that ends there. Of the tokens that
end at a prefix, exactly one is the last token of that prefix's BPE encoding: the one whose own encoding is itself and
which is compatible with the last token of the prefix before it. The table holds that token for every prefix, and the
pointers back from the last prefix give the ids.

Two tokens are compatible if BPE over their joined bytes keeps them apart. That is decided from merge ranks alone: the
right edge of the first token and the left edge of the second grow at known ranks, and a merge across the border would
have to come before one of the two edge symbols is taken up by a merge on its own side.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Remembering, freed, ids_of, slices
from .vocabulary import Vocabulary, vocabulary

NEVER = 1 << 60
#: Pre-tokens that a worker remembers: a bound of memory, not of the work.
REMEMBERED_WORDS = 150_000


class PrefixEncoder:
    def __init__(self, vocab: Vocabulary):
        import ahocorasick

        self.vocab = vocab
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(vocab.merges)}
        self.parts = {t: (a, b, r) for r, (a, b, t) in enumerate(vocab.merges)}
        tokens = [*vocab.byte_id, *(t for _, _, t in vocab.merges)]
        self.pairs: dict[int, bool] = {}
        sound: dict[int, bool] = dict.fromkeys(vocab.byte_id, True)
        for a, b, t in vocab.merges:  # a part comes before the tokens that it is part of
            sound[t] = sound[a] and sound[b] and not self.crossed(a, b, whole=True)
        self.automaton = ahocorasick.Automaton()
        for t in tokens:
            if sound[t]:
                self.automaton.add_word(vocab.bytes[t].decode("latin-1"), (len(vocab.bytes[t]), t))
        self.automaton.make_automaton()
        self.known: dict[str, bytes] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols on a side of the token, from itself to the byte, with the rank at which its own side takes each up."""
        out, taken = [], NEVER
        while part := self.parts.get(token):
            out.append((token, taken))
            taken, token = part[2], part[side]
        out.append((token, taken))
        return out

    def crossed(self, a: int, b: int, whole: bool = False) -> bool:
        """Whether a merge crosses the border between tokens a and b; ``whole`` leaves out the merge of a with b itself."""
        rank, left = self.rank, self.edge(b, 0)
        for x, x_taken in self.edge(a, 1):
            for y, y_taken in left:
                r = rank.get((x, y))
                # of equal ranks the merge further left comes first: x goes left, y stays for the border
                if r is not None and r < x_taken and r <= y_taken and not (whole and x == a and y == b):
                    return True
        return False

    def compatible(self, a: int, b: int) -> bool:
        fits = not self.crossed(a, b)
        if len(self.pairs) < 150_000:  # bounds the memory, not the work
            self.pairs[a << 32 | b] = fits
        return fits

    def word(self, word: str) -> bytes:
        """The ids of a pre-token, as uint32 bytes."""
        letters = word.encode().decode("latin-1")
        n = len(letters)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        pairs = self.pairs
        for at, (length, token) in self.automaton.iter(letters):
            end = at + 1
            if last[end] < 0:
                if length == end:
                    last[end], size[end] = token, length
                elif (before := last[end - length]) >= 0:
                    fits = pairs.get(before << 32 | token)
                    if fits or fits is None and self.compatible(before, token):
                        last[end], size[end] = token, length
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        out.reverse()
        return array("I", out).tobytes()

    def units(self, units: list[str]) -> list[bytes]:
        known, words, word, out = self.known, self.vocab.words, self.word, []
        for u in units:
            parts = []
            for w in words(u):
                x = known.get(w)
                if x is None:
                    x = word(w)
                    if len(known) < REMEMBERED_WORDS:
                        known[w] = x
                parts.append(x)
            out.append(parts[0] if len(parts) == 1 else b"".join(parts))
        return out


@cache
def encoder(path: str) -> Remembering:
    return Remembering(PrefixEncoder(vocabulary(path)).units)


def binary(flat: bytes, lengths: np.ndarray) -> pa.Array:
    """Consecutive values of the given byte lengths, without a copy for each."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def text_of(ids: np.ndarray, tokens: list[bytes]) -> str:
    return b"".join(map(tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns ``id_col`` and ``ids``, the ids of the whole text as little-endian unsigned 32-bit integers (binary).

    A null text counts as empty and gives empty ids; repeated rows each give a row; other columns are left behind, so
    clashing names do no harm. Work and memory of a task follow its texts; a text of any length is encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in freed(batches):
            for part, texts in slices(batch, "text"):
                ids, n = ids_of(texts, encoder(path), vocab.special)
                yield pa.RecordBatch.from_arrays([part.column(0), binary(ids.astype("<u4").tobytes(), n * 4)], names=["id", "ids"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Returns ``id_col``, ``ids`` and ``text``, the decoded text, special tokens kept. Null ids count as empty.

    Bytes that are no UTF-8 become U+FFFD. Unknown ids are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = vocabulary(path).bytes
        for batch in freed(batches):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [text_of(np.frombuffer(x or b"", "<u4"), of) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["id", "ids", "text"])

    plain = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, ids binary, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and decode() in one pass over the texts, so that a task needs one Python worker and not two.

    Returns ``id_col``, ``ids`` and ``text``. A null text counts as empty; repeated rows each give a row; an empty table
    gives none; other columns are left behind. A text of any length is encoded and decoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in freed(batches):
            for part, texts in slices(batch, "text"):
                ids, n = ids_of(texts, encoder(path), vocab.special)
                ends = np.cumsum(n)
                decoded = [text_of(ids[a:b], vocab.bytes) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), binary(ids.astype("<u4").tobytes(), n * 4), pa.array(decoded, pa.string())], names=["id", "ids", "text"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, ids binary, text string").withColumnRenamed("id", id_col)
