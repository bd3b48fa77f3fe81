"""Exact, cached use of two public tokenizers.

Both vocabularies first split a text into short pieces and then merge inside each piece only, so the ids of a
text are the joined ids of its blank-separated pieces. The tokenizers library is called once for each
distinct piece a Python worker meets; texts with unusual white space or with the string of a special token are handed to it whole.
"""

from __future__ import annotations

import os
import re
from array import array

#: Entries of each of a table's two generations (about 200 bytes an entry, two tables in a worker), for vocabularies that drop white space and those that keep it.
CACHE_ENTRIES = (260_000, 350_000)

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIMPLE = re.compile(rf"(\n?)([{_LETTERS}]+)([!-/:-@\[-`{{-~]*)")
_WORKER: dict[tuple[str, bool], PieceEncoder] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one printable character: printable Latin-1 as itself, others from U+0100 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(same)]
    return {b: chr(b) for b in same} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Table(dict):
    """Key to the key's ids as little-endian unsigned 32-bit bytes; a full generation becomes the old one."""

    def __init__(self, make, entries: int, longest: int = 64):
        super().__init__()
        self.make, self.entries, self.longest, self.old = make, entries, longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class PieceEncoder:
    """encode(text) gives the ids as bytes. blanks: the vocabulary keeps white space (byte-level), else it drops it."""

    def __init__(self, path: str, blanks: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that stand for a special token wherever they occur; a text with one is encoded whole
        self.marks = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.blanks, self.model = blanks, self.tokenizer.model
        self.letters = _byte_letters()
        self.runs = _Table(self._run, CACHE_ENTRIES[blanks])
        self.pieces = _Table(self._piece, CACHE_ENTRIES[blanks])

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> bytes:
        """Ids of what the tokenizer's own splitter would leave in one part."""
        if run.isascii() and run.isprintable():
            written = run.replace(" ", self.letters[32])
        else:
            written = run.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _piece(self, piece: str) -> bytes | None:
        """None where a text with this piece has white space that does not just part two words."""
        simple = _SIMPLE.fullmatch(piece)
        if not simple:
            bare = piece[1:] if piece[:1] == "\n" else piece
            if self.blanks and bare.split() != [bare]:
                return None
            return self.whole(f" {piece}" if self.blanks and piece[:1] != "\n" else piece)
        line, word, marks = simple.groups()
        if self.blanks:
            head = self.runs["\n"] + self.runs[word] if line else self.runs[f" {word}"]
        else:
            head = self.runs[word.lower()]
        return head + (self.runs[marks] if marks else b"")

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(mark in text for mark in self.marks):
            return self.whole(text)
        if not self.blanks:
            if text.isascii():
                text = text.lower()
            return b"".join(map(self.pieces.__getitem__, filter(None, text.replace("\n", " ").split(" "))))
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            return self.pieces[f"\n{first}"][4:] + b"".join(map(self.pieces.__getitem__, rest))
        except TypeError:  # a piece is None: runs of blanks, blanks at an end, or other white space
            return self.whole(text)


def encoder(path: str, blanks: bool) -> PieceEncoder:
    """One per Python worker and vocabulary."""
    if (path, blanks) not in _WORKER:
        _WORKER[path, blanks] = PieceEncoder(path, blanks)
    return _WORKER[path, blanks]
