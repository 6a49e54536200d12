"""Whole texts to token ids, one encoding for each distinct chunk.

The byte-level pattern never joins what stands before a space with that space and what follows it, as long as the
character after the space isn't white space. A text is therefore the concatenation of its chunks (a word with the space
before it), and each chunk is encoded by itself. Arrow splits and numbers the chunks of a slice of texts; an encoder
sees each distinct chunk of the slice once; numpy puts the ids together again. Texts with a space before white space or
at their end, or with a special token's string, take a slower way that cuts only where the rule holds.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded together, and chunks that a worker remembers: bounds of memory, not of the work.
SLICE_BYTES = 3 << 20
REMEMBERED = 100_000

CUT = re.compile(r"(?<=.)(?= \S)", re.S)


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.StringArray]]:
    """Runs of rows with at most ``most`` bytes of text (one row at least), and their texts with nulls as empty."""
    texts = pc.fill_null(batch.column(batch.schema.names.index(text)), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, upto - at), texts.slice(at, upto - at)
        at = upto


def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; Arrow's memory that one has needed goes back to the system before the next."""
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()


class Remembering:
    """An encoder of units that remembers its first results, ``most`` of them; frequent units come early."""

    def __init__(self, encode: Callable[[list[str]], list], most: int = REMEMBERED):
        self.encode, self.most, self.known = encode, most, {}

    def __call__(self, units: list[str]) -> list:
        known = self.known
        out = list(map(known.get, units))
        if missing := [i for i, x in enumerate(out) if x is None]:
            new = self.encode([units[i] for i in missing])
            for i, x in zip(missing, new, strict=True):
                out[i] = x
            if len(known) < self.most:
                known.update((units[i], out[i]) for i in missing[: self.most - len(known)])
        return out


class Pieces:
    """The units of a slice of texts: ``codes`` number, text by text, the entries of units(); ``docs`` counts each text's."""

    def __init__(self, texts: pa.StringArray, specials: list[str]):
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten().dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.rest = words.dictionary.to_pylist()
        counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        n = len(counts)
        starts = np.cumsum(counts) - counts
        first = np.zeros(len(codes), bool)
        first[starts] = True
        heads = pc.utf8_slice_codeunits(words.dictionary, 0, 1).dictionary_encode()
        odd = np.array([not c or c.isspace() for c in heads.dictionary.to_pylist()], bool)[heads.indices.to_numpy(zero_copy_only=False)]
        doc = np.repeat(np.arange(n), counts)
        slow = np.bincount(doc[odd[codes] & ~first], minlength=n) > 0
        for s in specials:
            slow |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        self.first = [self.rest[c] for c in codes[starts]]
        self.slow = {int(i): texts[int(i)].as_py() for i in np.flatnonzero(slow)}
        self.codes = np.where(first, len(self.rest) + doc, codes)[first | ~slow[doc]]
        self.docs = np.where(slow, 1, counts)
        self.starts = np.cumsum(self.docs) - self.docs

    def values(self, encode: Callable[[list[str]], list], special: dict[str, object], join: Callable[[list], object]) -> list:
        """What ``encode`` makes of each entry that ``codes`` may name; ``join`` puts a slow text's parts together."""
        out = encode([" " + w for w in self.rest])
        firsts = encode([w if i not in self.slow else "" for i, w in enumerate(self.first)])
        split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        for i, text in self.slow.items():
            parts = []
            for k, segment in enumerate(split.split(text) if split else [text]):
                parts += [special[segment]] if k % 2 else encode(CUT.split(segment))
            firsts[i] = join(parts)
        return out + firsts


def ids_of(texts: pa.StringArray, encode: Callable[[list[str]], list[bytes]], special: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in a row (uint32), and how many each text has. ``encode`` gives a unit's ids as uint32 bytes."""
    pieces = Pieces(texts, list(special))
    values = pieces.values(encode, {s: np.uint32(i).tobytes() for s, i in special.items()}, b"".join)
    lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
    table = np.frombuffer(b"".join(values), np.uint32)
    begins = np.cumsum(lengths) - lengths
    each = lengths[pieces.codes]
    ends = np.cumsum(each)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins[pieces.codes] - (ends - each), each)
    return table[at], np.add.reduceat(each, pieces.starts) if len(each) else each


def counts_of(texts: pa.StringArray, count: Callable[[list[str]], list[int]], specials: list[str]) -> np.ndarray:
    """How many ids each text has. ``count`` gives the units' numbers of ids."""
    pieces = Pieces(texts, specials)
    values = np.array(pieces.values(count, dict.fromkeys(specials, 1), sum), np.int64)
    return np.add.reduceat(values[pieces.codes], pieces.starts) if len(pieces.codes) else pieces.docs[:0]
