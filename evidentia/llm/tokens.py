"""Token ids of whole texts, exactly as the tokenizers library gives them, with each distinct chunk encoded once per worker.

A text is cut before every single space that a non-space character follows. Both supported pre-tokenizers begin a new
piece there whatever stands around it, so a text's ids are its chunks' ids in order. Chunks of Latin characters go
through the same merges in tiktoken (see ``unreachable``); any other chunk is encoded by the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import re
from array import array

#: Chunks that a worker keeps; beyond it the table is emptied and filled anew.
CACHE_CHUNKS = 600_000

#: Characters whose class, lower case and composition are the same in every Unicode version and library.
SAFE = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-įı-ſ‐-‧‰-⁞]*")
CUT = re.compile(r" (?=\S)")

#: The published split patterns of the two vocabularies, with the letters and digits that SAFE holds.
LETTER, DIGIT = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^\s{LETTER}{DIGIT}]+|\s+(?!\S)|\s+"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^\s{LETTER}{DIGIT}]+"


def byte_chars() -> dict[str, int]:
    """The usual printable stand-in of each byte, by rule: printable Latin-1 stands for itself, the rest follow from 256 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def library(path: str):
    """The tokenizer as the library reads it, single-threaded, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _spec(path: str) -> tuple[bool, dict[str, int], set[int], list[str]]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    spaced = spec["pre_tokenizer"]["type"] == "ByteLevel"
    return spaced, model["vocab"], {a["id"] for a in spec["added_tokens"]}, [a["content"] for a in spec["added_tokens"]]


def _symbols(token: str, spaced: bool, chars: dict[str, int]) -> bytes | None:
    """A token's bytes; byte 0xFF, which UTF-8 never has, stands for the end of a word."""
    end = b""
    if not spaced and token.endswith("</w>"):
        token, end = token[:-4], b"\xff"
    try:
        return bytes(chars[c] for c in token) + end
    except KeyError:
        return None


def unreachable(path: str) -> frozenset[int]:
    """Tokens that the library's merges never make from their own characters.

    Merging by the rank of the joined bytes equals merging by the list of pairs if every token comes out of its own
    characters; tokens for which it does not are left out of the ranks.
    """
    import tokenizers

    spaced, vocab, added, _ = _spec(path)
    with open(path, encoding="utf-8") as f:
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in json.load(f)["model"]["merges"]]
    inner = tokenizers.models.BPE(vocab, merges)
    last = inner if spaced else tokenizers.models.BPE(vocab, merges, end_of_word_suffix="</w>")
    bad = []
    for token, i in vocab.items():
        ends = not spaced and token.endswith("</w>")
        if i not in added and [x.id for x in (last.tokenize(token[:-4]) if ends else inner.tokenize(token))] != [i]:
            bad.append(i)
    return frozenset(bad)


class Table(dict):
    """A bounded memo: a missing key is made, and a full table is emptied first."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        made = self[key] = self.make(key)
        return made


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, bad: frozenset[int] = frozenset()):
        import tiktoken

        self.hf = library(path)
        self.spaced, vocab, added, self.specials = _spec(path)
        chars = byte_chars()
        ranks = {}
        for token, i in vocab.items():
            b = _symbols(token, self.spaced, chars)
            if i not in added and i not in bad and b:
                ranks[b] = i
        self.end = b"" if self.spaced else b"\xff"
        if not self.spaced:
            ranks[b"\xff"] = max(vocab.values()) + 1_000  # never left alone: each byte with the end is a token
        self.core = tiktoken.Encoding("ranks", pat_str=r".", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.rx = re.compile(BYTE_PATTERN if self.spaced else WORD_PATTERN)
        self.pieces = Table(self._piece, CACHE_CHUNKS)
        self.chunks = Table(self._chunk, CACHE_CHUNKS)

    def _piece(self, p: str) -> bytes:
        return array("I", self.core.encode_single_piece(p.encode() + self.end)).tobytes()

    def split(self, s: str) -> list[str] | None:
        """The pieces of a stretch that begins where a piece begins; None if only the library may cut it."""
        if not (s.isascii() or SAFE.fullmatch(s)) or "<|" in s and any(x in s for x in self.specials) or s.isascii() and not s.isprintable() and not SAFE.fullmatch(s):
            return None
        return self.rx.findall(s if self.spaced else s.lower())

    def stretch(self, s: str) -> bytes:
        pieces = self.split(s)
        if pieces is None:
            return array("I", self.hf.encode(s, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.pieces.__getitem__, pieces))

    def _chunk(self, chunk: str) -> bytes | None:
        """A chunk's ids. With spaced pieces it stands for the chunk after a space, and None says that it can't begin a chunk."""
        if not self.spaced:
            return self.stretch(chunk) if chunk else b""
        return None if not chunk or chunk[0].isspace() else self.stretch(" " + chunk)

    def encode(self, text: str) -> bytes:
        parts = text.split(" ")
        if not self.spaced:
            return b"".join(map(self.chunks.__getitem__, parts))
        first = self.stretch(parts[0]) if parts[0] else b""
        try:
            return first + b"".join(map(self.chunks.__getitem__, parts[1:]))
        except TypeError:  # a None: a longer run of white space
            parts = CUT.split(text)
            return self.stretch(parts[0]) + b"".join([self.stretch(" " + p) for p in parts[1:]])


_encoders: dict[str, Encoder] = {}


def encoder(path: str, bad: frozenset[int] = frozenset()) -> Encoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, bad)
    return _encoders[path]


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
