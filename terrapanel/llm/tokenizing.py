"""Token ids of whole texts with the public tokenizer files.

``WordIds`` gives the ids that ``Tokenizer.from_file(path).encode(text,
add_special_tokens=False)`` gives for vocabularies whose pieces never hold
white space (``word_bpe_49k.json``): every run of non-space characters is
then encoded independently of its neighbours, so each distinct run is
encoded once and remembered. The memory is bounded: a full cache starts
again empty.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache

#: What the vocabulary's normaliser calls white space (Unicode White_Space).
_RUNS = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Characters that ``str.split`` takes for white space and the normaliser doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Pieces of a lower-cased run, as the tokenizer file's own pattern cuts them.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same of visible ASCII characters.
_ASCII_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies:
    visible Latin-1 characters stand for themselves, the others follow from
    U+0100 on in byte order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class WordIds(dict):
    """Maps a run of non-space characters to its ids (little-endian uint32)."""

    def __init__(self, path: str, max_runs: int = 350_000, max_pieces: int = 250_000):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces = regex.compile(_PIECES)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or "(?!)")
        self.symbols = byte_symbols()
        self.known: dict[str, bytes] = {}
        self.max_runs, self.max_pieces = max_runs, max_pieces

    def __missing__(self, run: str) -> bytes:
        if len(self) >= self.max_runs:
            self.clear()
        if self.special.search(run):
            ids = array("I", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()
        elif run.isascii() and run.isprintable():
            low = run.lower()
            ids = self._piece(low) if low.isalpha() else b"".join(map(self._piece, _ASCII_PIECES.findall(low)))
        else:
            plain = run if run.isascii() else unicodedata.normalize("NFC", run)
            # letter by letter, as the normaliser does: no final-sigma rule
            low = plain.lower() if "Σ" not in plain else "".join(map(str.lower, plain))
            # Latin letters alone are one piece
            ids = self._piece(low) if low.isalpha() and max(low) < "\u0250" else b"".join(map(self._piece, self.pieces.findall(low)))
        self[run] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            if len(self.known) >= self.max_pieces:
                self.known.clear()
            shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.symbols)
            ids = self.known[piece] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian uint32 bytes."""
        runs = _RUNS.findall(text) if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self.__getitem__, runs))


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The encoder of a file, kept as long as the process: a Python worker
    runs many tasks, and each finds the words of those before."""
    return WordIds(path)
