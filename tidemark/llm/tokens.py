"""Encoding with the tokenizers library, a worker-wide cache of pre-tokens in front of it.

A vocabulary file fixes how texts are cut into pre-tokens, and each pre-token is
encoded on its own; so a pre-token has to be encoded once only. Texts whose characters
may be classed differently by two Unicode versions, texts that hold the string of an
added token, and files whose pre-tokenizer isn't known here, go through the library whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import numpy as np
import regex

#: Any but the characters that every Unicode version classes alike and NFC leaves alone.
_ODD = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u024f\u2013\u2014\u2018\u2019\u201c\u201d\u2026\u20ac]")
#: Pre-token patterns with letters tried first (no other alternative begins with one); <L>, <N>: the members of \\p{L}, \\p{N}.
_BYTE_LEVEL = r" ?[<L>]+|'(?:[stmd]|re|ve|ll)| ?[<N>]+| ?[^\s<L><N>]+|\s+(?!\S)|\s+"
_WORDS = r"[<L>]+|'(?:[stmd]|re|ve|ll)|[<N>]|[^\s<L><N>]+"
#: How vocabulary files write the second one.
_WORDS_WRITTEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Cached pre-tokens of a worker, about: when half of them are new, those that were not used since the last time go.
CACHED = 400_000
#: The characters that byte-level models have for the bytes 0 to 255: the printable ones stand for themselves.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: b if b in _PRINTED else 0x100 + len({*range(b)} - _PRINTED) for b in range(256)}


def _compiled(template: str) -> re.Pattern:
    """The pattern for plain texts: letters and numbers below U+0250 as written-out classes."""
    members = lambda name: re.escape("".join(chr(c) for c in range(0x250) if regex.match(rf"\p{{{name}}}", chr(c))))
    return re.compile(template.replace("<L>", members("L")).replace("<N>", members("N")))


class _Known(dict):
    """The ids of pre-tokens as little-endian bytes; what isn't known yet is encoded by the file's model."""

    def __init__(self, model, width: int):
        self.model, self.width, self.earlier = model, width, {}

    def __missing__(self, part: str) -> bytes:
        found = self.earlier.get(part)
        if found is None:
            found = b"".join([t.id.to_bytes(self.width, "little") for t in self.model.tokenize(part.encode().decode("latin-1").translate(_BYTES))])
        self[part] = found
        return found

    def trim(self) -> None:
        if len(self) > CACHED // 2:
            self.earlier = dict(self)
            self.clear()


class Encoder:
    """ids() of texts as the library gives them with add_special_tokens=False."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added), re.IGNORECASE) if added else None
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            pattern, self.lower = self._cut(json.load(file))
        self.pattern = pattern and _compiled(pattern)
        self.cache = _Known(self.tokenizer.model, self.dtype.itemsize)

    @staticmethod
    def _cut(spec: dict) -> tuple[str | None, bool]:
        """The pattern of pre-tokens and whether texts become lower case, for the two known layouts."""
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        if spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
            return None, False
        if norm is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            return _BYTE_LEVEL, False
        steps = pre.get("pretokenizers", [])
        if norm and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["invert"] and steps[0]["behavior"] == "Removed" and not steps[1]["use_regex"]:
            return (_WORDS, True) if steps[0]["pattern"]["Regex"] == _WORDS_WRITTEN else (None, False)
        return None, False

    def _packed(self, encodings: Iterable) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in encodings]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian bytes of self.dtype; null is empty."""
        out: list[bytes] = [b""] * len(texts)
        whole = []
        for i, text in enumerate(texts):
            if text:
                plain = self.pattern and not _ODD.search(text) and not (self.added and self.added.search(text))
                lowered = text.lower() if plain and self.lower else text
                if plain and (lowered is text or not _ODD.search(lowered)):
                    self.cache.trim()
                    out[i] = b"".join(map(self.cache.__getitem__, self.pattern.findall(lowered)))
                else:
                    whole.append(i)
        for i, packed in zip(whole, self._packed(self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)), strict=True):
            out[i] = packed
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process. The file has to be on every worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's task slots are the parallelism
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
