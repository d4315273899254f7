"""Byte-pair encoding with the tokenizers library, with a memory of pre-tokens.

A tokenizers file cuts a text into pre-tokens by a fixed pattern and merges each
alone, so equal pre-tokens always get equal ids. The library's model is asked
once for each distinct pre-token a worker sees; a text's ids are the remembered
answers in a row. Only plain Latin-1 text without the file's special tokens
takes that way, where case, classes and normal forms are beyond doubt; any other
text is given whole to the library's ``encode``.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

#: Remembered pre-tokens of a worker (about 200 bytes each); the older half goes when it is full.
MEMORY = 300_000
#: Pre-tokens longer than this are not remembered.
LONGEST = 64
#: Fixed value: the pattern that the library's ByteLevel step applies.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Latin-1 characters of which case, class and normal form are the same everywhere, and their classes.
PLAIN = r"[\x09-\x0D\x20-\x7E\xA1-\xFF]*"
CLASSES = {r"\s": r"\x09-\x0D\x20", r"\p{L}": r"A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\xFF", r"\p{N}": r"0-9\xB2\xB3\xB9\xBC-\xBE"}


def latin_pattern(pattern: str) -> str | None:
    """The pattern with its classes spelled out for Latin-1; None if it uses anything else."""
    pattern = re.sub(r"(?<!\[)\\S", "[^" + CLASSES[r"\s"].replace("\\", r"\\") + "]", pattern)
    out, inside = "", False
    for part in re.findall(r"\\p\{[LN]\}|\\s|\\x[0-9A-F]{2}|\\.|[^\\]", pattern):
        inside = part == "[" or inside and part != "]"
        if part in CLASSES:
            out += CLASSES[part] if inside else f"[{CLASSES[part]}]"
        elif part[0] == "\\" and part[1] != "x":
            return None
        else:
            out += part
    return out


def byte_characters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memory(dict):
    """pre-token -> ids as little-endian unsigned 32-bit integers; asks the model for what it lacks."""

    def __init__(self, model, most: int):
        super().__init__()
        self.most = most
        self.ask, self.old = model.tokenize, {}
        self.table = byte_characters()
        self.space = self.table[32]

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            # printable ASCII other than the space stands for itself
            name = piece.replace(" ", self.space) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.table)
            ids = array("I", [t.id for t in self.ask(name)]).tobytes()
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids

    def trim(self) -> None:
        if len(self) > self.most // 2:
            self.old = dict(self)
            self.clear()


class Encoder:
    """ids of texts, as the library's ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        steps = spec["pre_tokenizer"] or {}
        steps = steps.get("pretokenizers", [steps])
        kinds = [s.get("type") for s in steps]
        names = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        self.lower = names == ["NFC", "Replace", "Lowercase"]
        pattern = None
        if kinds == ["ByteLevel"] and steps[0]["use_regex"] and not steps[0]["add_prefix_space"] and not spec["normalizer"]:
            pattern = latin_pattern(BYTE_LEVEL_PATTERN)
        elif kinds == ["Split", "ByteLevel"] and steps[0]["invert"] and steps[0]["behavior"] == "Removed" and not steps[1]["use_regex"] and self.lower:
            pattern = latin_pattern(steps[0]["pattern"]["Regex"])
        if spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
            pattern = None
        self.cut = re.compile(pattern).findall if pattern else None
        self.plain = re.compile(PLAIN).fullmatch
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.memory = Memory(self.tok.model, memory)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.cut is None or not self.plain(text) or any(s in text for s in self.special):
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        self.memory.trim()
        return b"".join(map(self.memory.__getitem__, self.cut(text.lower() if self.lower else text)))


@lru_cache(maxsize=4)
def encoder(path: str, memory: int = MEMORY) -> Encoder:
    """One encoder a worker, file and size of memory."""
    return Encoder(path, memory)


def vocabulary(name: str) -> str:
    """Where the public tokenizers package keeps a file (looked up on the worker that reads it)."""
    import public_tokenizers

    return public_tokenizers.path(name)
