"""A byte-level BPE vocabulary file (tokenizers' JSON): tokens as bytes, merges as ids, special strings.

Texts are split as the tokenizers library splits them. The ``regex`` module knows another version of Unicode, so the pattern
is applied here only to letters up to U+024F, on which the two are compared when a file is loaded; anything else is split
by the library's own pre-tokenizer.
"""

from __future__ import annotations

import json
import re
from functools import cache

import regex
from tokenizers.pre_tokenizers import ByteLevel

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The last code point that the pattern is applied to.
LATIN = 0x24F


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes for themselves, the others from U+0100 on, in order."""
    out, more = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + more))
            more += 1
    return out


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, to_byte = file["model"], {c: b for b, c in enumerate(byte_letters())}
        assert model["type"] == "BPE" and file["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not file["normalizer"] and not model.get("ignore_merges"), path
        ids = model["vocab"]
        assert not any(t[k] for t in file["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized")), path
        #: The longest first, as the library prefers it where several begin at one place.
        self.special = {t["content"]: t["id"] for t in sorted(file["added_tokens"], key=lambda t: -len(t["content"]))}
        self.bytes: list[bytes] = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for t, i in ids.items():
            self.bytes[i] = bytes(to_byte[c] for c in t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.byte_id = [ids[c] for c in byte_letters()]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: In order of rank: left id, right id, id of the merged token.
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        assert len({m[2] for m in self.merges}) == len(self.merges), "a token that two merges make"
        self.pattern = regex.compile(PATTERN)
        self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        unlike = [c for c in map(chr, range(128, LATIN + 1)) if any(self.pattern.findall(x) != self.split(x) for x in (f"a{c}", f" {c}", f"1{c}", f"!{c}", f"{c}'s", f"{c} "))]
        self.beyond = re.compile(f"[^\0-{chr(LATIN)}]" + "".join(f"|{re.escape(c)}" for c in unlike))

    def split(self, unit: str) -> list[str]:
        """The library's own pre-tokens."""
        return [unit[a:b] for _, (a, b) in self.library.pre_tokenize_str(unit)]

    def words(self, unit: str) -> list[str]:
        """The pre-tokens of a unit."""
        if not unit.isascii() and self.beyond.search(unit):
            return self.split(unit)
        word = unit.rstrip(",.")
        if word and (word[1:] if word[0] == " " else word).isalpha():  # letters, then commas and full stops or nothing
            return [word] if len(word) == len(unit) else [word, unit[len(word) :]]
        return self.pattern.findall(unit)


@cache
def vocabulary(path: str) -> Vocabulary:
    """A worker loads a file once."""
    return Vocabulary(path)
