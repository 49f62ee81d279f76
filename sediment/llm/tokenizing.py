"""A tokenizer's ids by pieces that it treats independently, so that repeated pieces are encoded once.

The vocabulary files split at white space before anything else: no token spans a change from another character to
white space. Cutting there and joining the pieces' ids is therefore the ids of the whole text. Texts with unusual white
space, on whose extent libraries differ, are encoded whole. Special strings hold no white space and stay in one piece.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

_ODD = re.compile(
    "[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200d\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]"
)
_PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
LONGEST_KEPT = 64


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


class PieceEncoder(dict):
    """Ids of texts (little-endian unsigned 32-bit, as bytes) by the given tokenizer file; the dictionary keeps pieces.

    ``keep_space``: the tokenizer gives ids to white space. ``entries`` bounds the pieces kept; longer pieces are not.
    """

    def __init__(self, path: str, keep_space: bool, entries: int = 700_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.find = _PIECE.findall if keep_space else str.split
        self.entries = entries
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _library(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, piece: str) -> bytes:
        return self._library(piece)

    def __missing__(self, piece: str) -> bytes:
        found = self.encode(piece)
        if len(piece) <= LONGEST_KEPT:
            self[piece] = found
        return found

    def ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            out.append(self._library(text) if _ODD.search(text) else b"".join(map(self.__getitem__, self.find(text))))
            if len(self) > self.entries:
                self.clear()
        return out


class RankedEncoder(PieceEncoder):
    """The same, with new pieces encoded from the file of ranks of the same vocabulary, which is faster."""

    def __init__(self, path: str, ranks: str, pattern: str, **more):
        super().__init__(path, keep_space=True, **more)
        import base64

        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def encode(self, piece: str) -> bytes:
        if any(s in piece for s in self.special):
            return self._library(piece)
        return _packed(self.ranked(piece))


_LETTERS = "a-z\\xe0-\\xf6\\xf8-\\xff"
_PARTS = re.compile(f"[{_LETTERS}]+|[0-9]|[!-&(-/:-@\\\\[-`{{-~]+")
_SAFE = re.compile(f"[{_LETTERS}0-9!-&(-/:-@\\\\[-`{{-~]*")
_LOWER = {c: c + 32 for c in (*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF))}


class WordEncoder(PieceEncoder):
    """For a vocabulary of lower-case words with word ends, where white space has no ids.

    A piece of Latin letters, digits and ASCII marks without apostrophes folds letter by letter and falls into runs of
    letters, single digits and runs of marks, as the library has it; these parts are encoded by the file's merges in
    rank order. Every other piece goes to the library.
    """

    def __init__(self, path: str, **more):
        super().__init__(path, keep_space=False, **more)
        import tiktoken
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        end, ids = model["end_of_word_suffix"], model["vocab"]
        printable = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
        others = [c for c in range(256) if c not in set(printable)]
        byte_of = {chr(c): c for c in printable} | {chr(256 + i): c for i, c in enumerate(others)}
        assert set(byte_of) == set(pre_tokenizers.ByteLevel.alphabet())
        # a word's end is written as a line break, which no word holds; single bytes come first, then last bytes
        tokens = {bytes([b]): ids[c] for c, b in byte_of.items()}
        tokens |= {bytes([b]) + b"\n": ids[c + end] for c, b in byte_of.items()}
        for merge in model["merges"]:
            whole = "".join(merge if isinstance(merge, list) else merge.split(" "))
            bare = whole.removesuffix(end)
            tokens.setdefault(bytes(byte_of[c] for c in bare) + b"\n" * (bare != whole), ids[whole])
        self.id_of = [_packed([i]) for i in tokens.values()]
        ranks = {t: i for i, t in enumerate(tokens)}
        self.ranked = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, piece: str) -> bytes:
        low = piece.lower() if piece.isascii() else piece.translate(_LOWER)
        if low.isalpha() and _SAFE.fullmatch(low):
            if low in self:
                return self[low]
            id_of = self.id_of
            found = b"".join([id_of[i] for i in self.ranked(low + "\n")])
            if len(low) <= LONGEST_KEPT:
                self[low] = found
            return found
        if not _SAFE.fullmatch(low) or any(s in low for s in self.special):
            return self._library(piece)
        parts = _PARTS.findall(low)
        if len(parts) == 1:
            id_of = self.id_of
            return b"".join([id_of[i] for i in self.ranked(low + "\n")])
        return b"".join(map(self.__getitem__, parts))


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str) -> PieceEncoder:
    """The encoder for a file of the public vocabularies."""
    path = public_path(name)
    if name.startswith("word_"):
        return WordEncoder(path)
    if os.path.exists(ranks := path.removesuffix(".json") + ".tiktoken"):
        import public_tokenizers

        return RankedEncoder(path, ranks, public_tokenizers.PATTERN)
    return PieceEncoder(path, keep_space=True)
