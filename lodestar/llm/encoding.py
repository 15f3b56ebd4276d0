"""Token ids of whole texts by a tokenizers file.

The file's vocabulary and merges are loaded into tiktoken's byte-pair encoder, which gives the same ids several times
faster. That holds where merges are ranked in order of their ids, which is checked when a file is loaded, and where both
libraries class the characters of a text alike; all other texts, and those with added tokens, go through tokenizers.

bytes: byte-level BPE without normaliser. words: BPE with word ends; its text is lower-cased NFC, pieces are letters,
single digits or other signs, white space is dropped. A word end is a space after the piece, which no piece contains.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: Characters that are encoded fast: Latin, Greek and Cyrillic ones and common signs, without those that regex engines
#: class differently.
_PLAIN = [chr(c) for c in range(0x530) if c not in (0x1C, 0x1D, 0x1E, 0x1F, 0x85)] + [chr(c) for c in range(0x2010, 0x2028)] + ["€"]


def _class(kind: str) -> str:
    """The plain characters of a Unicode category, for a set in a regex."""
    return "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == kind)


_ODD = re.compile(f"[^{''.join(map(re.escape, _PLAIN))}]")
# How the two kinds of files cut a text into pieces.
_BYTES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WORDS = re.compile(rf"[{_class('L')}]+|'(?:[stmd]|re|ve|ll)|[{_class('N')}]|[^\s{_class('L')}{_class('N')}]+")


def _byte_of_char() -> dict[str, int]:
    """Byte-level files write a byte that prints as itself, and the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def located(path: str) -> str:
    """The place of a vocabulary file on this machine: path itself, or where it is a bare name that of the installed
    public tokenizers, which may lie elsewhere on each worker."""
    if os.path.sep in path or os.path.exists(path):
        return path
    import public_tokenizers

    return str(public_tokenizers.path(path))


class Encoder:
    """encode gives ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        path = located(path)
        self.tokenizer, self.words = Tokenizer.from_file(path), kind == "words"
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte, end = _byte_of_char(), model.get("end_of_word_suffix") or ""
        ranks = {}
        for token, i in model["vocab"].items():
            ended = bool(end) and token.endswith(end)
            body = token[: -len(end)] if ended else token
            if token.lower() not in self.added and all(c in byte for c in body):
                ranks[bytes(byte[c] for c in body) + b" " * ended] = i
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        self.fast = None
        if merged == sorted(merged) and all(bytes([b]) in ranks for b in range(256)):
            self.fast = tiktoken.Encoding("own", pat_str="[^ ]+ " if self.words else _BYTES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = _WORDS.findall

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        for text in texts:
            odd = self.fast is None or _ODD.search(text) or ("<" in text and any(a in text.lower() for a in self.added))
            if odd:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            elif self.words:
                plain = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
                found = self.pieces(plain)
                yield self._packed(self.fast(" ".join(found) + " ") if found else [])
            else:
                yield self._packed(self.fast(text))

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        out = array("I", ids)
        return out.tobytes() if out.itemsize == 4 and np.little_endian else np.array(ids, dtype="<u4").tobytes()
