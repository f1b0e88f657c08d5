"""Encoding by a public tokenizer, with words that occur again looked up instead of encoded again.

``IdEncoder.encode`` returns exactly what the tokenizers library returns for the whole text. Texts are
cut only where the tokenizer itself always cuts, and each distinct piece is encoded once per worker.
As in the library's default, the written form of an added token (such as an end mark) becomes that token;
texts that hold one go through the library whole. ``plain`` makes such strings ordinary text.
"""

from __future__ import annotations

import json
import os
import re

from terravox.llm.common import begin, keeps

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A space before other white space: there the pieces of a byte-level tokenizer depend on each other.
_RUNS = [" " + chr(c) for c in range(0x3001) if chr(c).isspace()]
#: Latin letters, then one run of ASCII signs (no apostrophe): two pieces to every tokenizer handled here.
_SIGNED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_ENCODERS: dict[tuple, IdEncoder] = {}
keeps("tokens", _ENCODERS.clear)


def byte_letters() -> dict[int, str]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Memo(dict):
    """piece -> ids as little-endian 32-bit integers.

    Pieces are kept from their second occurrence on, since most distinct pieces occur once; a byte per hash tells. A full
    memo is read but no longer written.
    """

    SEEN = 1 << 22

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.seen = make, limit, bytearray(self.SEEN)

    def __missing__(self, piece: str) -> bytes:
        ids = self.make(piece)
        if len(self) < self.limit:
            slot = hash(piece) & (self.SEEN - 1)
            if self.seen[slot]:
                self[piece] = ids
            self.seen[slot] = 1
        return ids


class IdEncoder:
    def __init__(self, path: str, memo: int = 400_000, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t for t in spec.get("added_tokens") or [] if not (plain and t.get("special"))]
        self.added = [t["content"] for t in added]
        self.kind = "whole" if any(t.get("normalized") for t in added) else self._kind(spec)
        letters = byte_letters()
        self.stand_in = str.maketrans({chr(b): c for b, c in letters.items()})
        self.space = letters[32]
        self.tokenize = self.tokenizer.model.tokenize
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.inner = _Memo(self._inner, memo)
        self.first = _Memo(lambda p: self._piece(p, ""), memo)
        self.spaced = _Memo(lambda p: self._piece(p, " "), memo)

    @staticmethod
    def _kind(spec: dict) -> str:
        """byte: words keep their leading space; word: white space is dropped; whole: not known, never cut."""
        pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}, spec.get("model") or {}
        if model.get("type") != "BPE" or model.get("dropout") or model.get("unk_token"):
            return "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            return "byte"
        steps = [x.get("type") for x in pre.get("pretokenizers", [])]
        norms = [x.get("type") for x in norm.get("normalizers", [])]
        if steps == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"] and pre["pretokenizers"][0].get("invert"):
            return "word"
        return "whole"

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _inner(self, letters: str) -> bytes:
        """One piece that consists of Latin letters alone, perhaps after a space, through the library's BPE model."""
        mapped = letters.replace(" ", self.space) if letters.isascii() else letters.encode("utf-8").decode("latin-1").translate(self.stand_in)
        return b"".join([self.packed[t.id] for t in self.tokenize(mapped)])

    def _piece(self, piece: str, lead: str) -> bytes:
        word = self.kind == "word"
        if _LETTERS.fullmatch(piece):
            return self._inner(piece.lower() if word else lead + piece)
        if m := _SIGNED.fullmatch(piece):
            return self.inner[m[1].lower() if word else lead + m[1]] + self.first[m[2]]
        if not word:
            a, line, b = piece.partition("\n")
            if line and a and b and not a[-1].isspace() and not b[0].isspace():
                return self._piece(a, lead) + self.first["\n"] + self.first[b]
        return self.whole(lead + piece)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(token in text for token in self.added):
            return self.whole(text)
        if self.kind == "word":
            return b"".join(map(self.first.__getitem__, text.replace("\n", " ").split(" ")))
        if self.kind == "byte" and not any(run in text for run in _RUNS):
            head, *rest = text.split(" ")
            return (self.first[head] if head else b"") + b"".join(map(self.spaced.__getitem__, rest))
        return self.whole(text)


def encoder(path: str, memo: int = 400_000, plain: bool = False) -> IdEncoder:
    """One encoder per worker process and file."""
    begin("tokens")
    key = (path, memo, plain)
    if key not in _ENCODERS:
        _ENCODERS[key] = IdEncoder(path, memo, plain)
    return _ENCODERS[key]
