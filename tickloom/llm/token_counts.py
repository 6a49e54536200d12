"""Token counts by rank-synchronous merging of ragged numpy arrays.

The distinct pre-tokens of a slice lie end to end in one array of symbols. In each round every sequence merges its
lowest-ranked pair, wherever it occurs, all sequences at once; sequences with no pair left leave the array with their
number of symbols.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Remembering, counts_of, freed, slices
from .vocabulary import Vocabulary, vocabulary

NONE = np.int32(2**31 - 1)


class RankMerger:
    def __init__(self, vocab: Vocabulary):
        self.vocab, self.base = vocab, len(vocab.bytes)
        merges = np.array(vocab.merges, np.int64).reshape(-1, 3)
        keys = merges[:, 0] * self.base + merges[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), merges[:, 2].astype(np.int32)
        self.byte_id = np.array(vocab.byte_id, np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def sizes(self, words: list[str]) -> np.ndarray:
        """The number of symbols that survive in each pre-token."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        out, seq = lengths.copy(), np.flatnonzero(lengths > 1)
        symbols = self.byte_id[np.frombuffer(b"".join(raw[i] for i in seq), np.uint8)]
        lengths = lengths[seq]
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(lengths) - 1] = True
        ranks = np.full(len(symbols), NONE)
        if len(symbols):
            ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
            ranks[last] = NONE
        while len(seq):
            starts = np.cumsum(lengths) - lengths
            least = np.minimum.reduceat(ranks, starts)
            if (done := least == NONE).any():
                out[seq[done]] = lengths[done]
                stay = np.repeat(~done, lengths)
                symbols, ranks, last = symbols[stay], ranks[stay], last[stay]
                seq, lengths, least = seq[~done], lengths[~done], least[~done]
                continue
            hit = ranks == np.repeat(least, lengths)
            # in a run of overlapping hits (a symbol repeated) every other one merges, from the left
            where = np.flatnonzero(hit)
            fresh = np.diff(where, prepend=-2) != 1
            run = np.cumsum(fresh) - 1
            hit[where[(where - where[fresh][run]) % 2 == 1]] = False
            where = np.flatnonzero(hit)
            symbols[where] = self.made[ranks[where]]
            last[where] = last[where + 1]
            gone = np.zeros(len(symbols), bool)
            gone[where + 1] = True
            lengths = lengths - np.add.reduceat(hit, np.cumsum(lengths) - lengths, dtype=np.int64)
            touched = hit.copy()
            touched[:-1] |= hit[1:]  # the pair before a merge
            touched[where[where > 1] - 2] |= gone[where[where > 1] - 1]  # the same where the symbol between goes
            keep = ~gone
            symbols, ranks, last, touched = symbols[keep], ranks[keep], last[keep], touched[keep]
            renew = np.flatnonzero(touched & ~last)
            ranks[renew] = self.rank(symbols[renew], symbols[renew + 1])
            ranks[last] = NONE
        return out

    def units(self, units: list[str]) -> list[int]:
        lists = [self.vocab.words(u) for u in units]
        number: dict[str, int] = {}
        for w in chain.from_iterable(lists):
            number.setdefault(w, len(number))
        sizes = self.sizes(list(number))
        codes = np.fromiter(map(number.__getitem__, chain.from_iterable(lists)), np.int64)
        totals = np.concatenate(([0], np.cumsum(sizes[codes])))
        ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        return np.diff(totals[ends], prepend=0).tolist()


@cache
def counter(path: str) -> Remembering:
    return Remembering(RankMerger(vocabulary(path)).units)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns ``id_col``, ``n_bytes`` and ``n_tokens`` (long) of each whole text; special strings count as their one id.

    A null text counts as empty (0 and 0); repeated rows each give a row; other columns are left behind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in freed(batches):
            for part, texts in slices(batch, "text"):
                n = counts_of(texts, counter(path), list(vocab.special))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
