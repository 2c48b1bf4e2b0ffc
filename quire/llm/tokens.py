"""Token ids of whole texts as the tokenizers library gives them, with a memo of pre-tokens.

A byte-pair encoder splits a text into pre-tokens by a pattern and encodes each alone. So each distinct
pre-token goes to the library once, and a text is the concatenation of what its pre-tokens gave. The memo is
used only where the split is known to be the library's: the file's pattern is one of SPLITS, and the text holds
only characters of SAFE, for which Python and the library agree on classes, lower case and normal form, and no
string that could be a special token. Any other text goes to the library whole.
"""

from __future__ import annotations

import array
import json
import os
import re
import sys

#: ASCII and the letters of Latin-1 and Latin Extended-A, but for those whose lower case or class differs.
SAFE = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ňŊ-ž]*")
#: Of SAFE: letters, and what is neither letter, digit nor white space.
LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ž", r"!-/:-@\[-`{-~"
#: The split patterns of the known files, over the characters of SAFE, the most frequent kind first.
SPLITS = {
    "gpt2": re.compile(rf" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[{SIGNS}]+|\s+(?!\S)|\s+"),
    "words": re.compile(rf"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[{SIGNS}]+"),
}
#: The pattern by which the second kind of file splits, as that file states it.
WORDS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pre-tokens in the memo at most; then it starts anew. Longer ones than MEMO_CHARS are not kept.
MEMO_SIZE, MEMO_CHARS = 600_000, 48


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if Latin-1 prints it, else the next one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def _packed(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _kind(spec: dict) -> str | None:
    """Which of SPLITS a tokenizer file uses, or None."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec.get("truncation") or spec.get("padding") or (spec.get("model") or {}).get("dropout"):
        return None
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "gpt2"
    steps = pre.get("pretokenizers") or []
    names = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    if (
        len(steps) == 2
        and steps[0].get("pattern") == {"Regex": WORDS_PATTERN}
        and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
        and steps[1].get("type") == "ByteLevel"
        and not steps[1].get("use_regex")
        and names == ["NFC", "Replace", "Lowercase"]
    ):
        return "words"
    return None


class _Memo(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, piece):
        value = self.make(piece)
        if len(piece) <= MEMO_CHARS:
            self[piece] = value
        return value


class Encoder:
    """ids(text) as bytes of little-endian unsigned 32-bit ids, count(text) as their number."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lib = Tokenizer.from_file(path)
        kind = _kind(spec)
        self.lower = kind == "words"
        self.split = SPLITS[kind].findall if kind else None
        self.special = [x["content"] for x in spec.get("added_tokens") or []]
        self.model = self.lib.model
        self.packed, self.counted = _Memo(lambda p: _packed([t.id for t in self._piece(p)])), _Memo(lambda p: len(self._piece(p)))

    def _ids(self, text: str) -> list[int]:
        return self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _piece(self, piece: str) -> list:
        """The library's model on one pre-token, whose bytes stand there as letters."""
        return self.model.tokenize(piece.encode().decode("latin-1").translate(_LETTERS))

    def _pieces(self, text: str) -> list[str] | None:
        if self.split is None or SAFE.fullmatch(text) is None or any(s in text for s in self.special):
            return None
        return self.split(text.lower() if self.lower else text)

    def ids(self, text: str) -> bytes:
        if len(self.packed) > MEMO_SIZE:
            self.packed.clear()
        pieces = self._pieces(text)
        return _packed(self._ids(text)) if pieces is None else b"".join(map(self.packed.__getitem__, pieces))

    def count(self, text: str) -> int:
        if len(self.counted) > MEMO_SIZE:
            self.counted.clear()
        pieces = self._pieces(text)
        return len(self._ids(text)) if pieces is None else sum(map(self.counted.__getitem__, pieces))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker; tasks of a reused worker share its memo."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
