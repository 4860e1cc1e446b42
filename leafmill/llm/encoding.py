"""Token ids of whole texts, by the tokenizers library.

Invented and natural prose repeat their words, and a tokenizer that splits at white space gives a
text the ids of its space-separated pieces in a row. ``Encoder`` uses that: it keeps the ids of
pieces in a bounded cache and asks the library only for pieces that it has not met. Where letters
and signs are split and case is ignored too, texts of Latin letters are lower-cased and spaced out as
a whole, so that a word with its comma is the word and the comma. Other tokenizers begin a piece at a space: their pieces
keep it. Whether a tokenizer splits in one of these ways is tried on probes; one that doesn't gets whole texts.
"""

from __future__ import annotations

import os
import re
from array import array

from .common import release_memory

#: A character that a text to be spaced out has none of: control, beyond Latin letters, or one whose
#: lower case is two characters.
_OTHER = re.compile("[^\n -~À-ÖØ-öø-įı-ž]")
#: A run of signs; an apostrophe may begin a contraction, so runs beside one stay where they are.
_SIGNS = r"!-&(-/:-@\[-`{-~"
_RUN = re.compile(f"(?<![{_SIGNS}'])([{_SIGNS}]++)(?!')")
#: Another sign than a full stop or comma, or one of these that ends a run of signs.
_SIGNED = re.compile(f"[!-+/:-@\\[-`{{-~-]|[.,][.,]")

#: Where a piece that keeps its space begins: a run of white space is not parted.
_BEFORE_SPACE = re.compile(r"(?<!\s)(?= )")
_LATER_SPACE = re.compile(r"\s ")
_BEYOND = re.compile("[^\0-ɏ]")
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
#: Fixed value: how byte-level tokenizers split text before merges, over characters up to U+024F.
_BYTE_LEVEL = re.compile(f" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")

PROBES = (
    "Don't stop.The end, été naïve x1y2 33-44 Über STRASSE 中文 \U0001f600! a.b c's 's ...",
    "a  b\n\nc\td  e　f g",
    "one two three. Four, five;six 'll 've foo_bar <|x|> <a> \\n %% $$$",
    "A.b..c'd 'E'., ''f.' g'h--i_j __k` x1.2y~~ É. ÎLE,ž; ßO?! (l'eau) [a-b]\n\nend.",
)


def _byte_letters() -> dict[int, str]:
    """Byte to visible character: printable ones stand for themselves, the others follow from 256."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in keep else chr(next(rest)) for b in range(256)}


class Encoder(dict):
    """Piece -> ids as little-endian unsigned 32-bit bytes. At most ``limit`` pieces are kept."""

    limit = 150_000
    #: Of byte-level pieces, which are smaller: words without the signs behind them.
    byte_limit = 400_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.by_piece = all(
            self._library(p) == b"".join(self._library(x) for x in p.replace("\n", " ").split(" ")) for p in PROBES
        )
        self.leading = not self.by_piece and all(self._library(p) == b"".join(map(self._library, self._at_spaces(p))) for p in PROBES)
        self.bytes = self.leading and all(self._library(p) == b"".join(map(self._bytes, _BYTE_LEVEL.findall(p))) for p in PROBES if not self._beyond(p))
        if self.bytes:
            self.limit = self.byte_limit
            if hasattr(self.tokenizer.model, "_resize_cache"):  # the library's own costs more than it gives to words met once
                self.tokenizer.model._resize_cache(0)
        self.spaced = False
        self.plain = self.by_piece and all(
            self._model(w) == self._library(w) for w in ("the", "thinking", "élève", "über", "zzyzx")
        )

        self.spaced = self.plain and all(self._library(p) == self._space_out(p) for p in PROBES if not _OTHER.search(p))
        self.clear()
        release_memory()  # what parsing the vocabulary has taken

    def _space_out(self, text: str) -> bytes:
        low = text.lower()
        if _SIGNED.search(low):
            low = _RUN.sub(r" \1 ", low)
        else:  # plain prose: stops and commas stand alone behind words
            low = low.replace(". ", " . ").replace(", ", " , ").replace(".\n", " .\n").replace(",\n", " ,\n")
        return b"".join(map(self.__getitem__, low.split()))

    @staticmethod
    def _beyond(text: str) -> bool:
        """Whether a text has what only the library splits: characters beyond Latin letters, or special tokens."""
        return "<|" in text or not text.isascii() and bool(_BEYOND.search(text))

    @staticmethod
    def _at_spaces(text: str) -> list[str]:
        """Pieces that begin at a space, which each keeps."""
        if "\0" in text or _LATER_SPACE.search(text):
            return _BEFORE_SPACE.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _model(self, word: str) -> bytes:
        """Ids of one lower-case word of letters: no normaliser or splitter changes it."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def _bytes(self, piece: str) -> bytes:
        """Ids of one piece of a byte-level tokenizer."""
        if piece.isascii() and piece[1:].isalnum():
            shown = self.letters[ord(piece[0])] + piece[1:]
        else:
            shown = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _keep(self, piece: str, ids: bytes) -> bytes:
        if len(self) >= self.limit:
            # Frequent pieces come early: the first half stays.
            for k in list(self)[self.limit // 2 :]:
                del self[k]
        self[piece] = ids
        return ids

    def __missing__(self, piece: str) -> bytes:
        if self.bytes:
            return self._keep(piece, self._bytes(piece))
        if not self.plain:
            return self._keep(piece, self._library(piece))
        word = piece[:-1] if piece[-1:] in (".", ",", ";", ":", "!", "?") else piece
        # Letters of Latin-1 and Latin Extended-A only: composed already, lower() is one to one.
        if not word.isalpha() or max(word) > "ž" or "İ" in word or "ŉ" in word:
            return self._keep(piece, self._library(piece))
        low = word.lower()
        ids = self.get(low)
        if ids is None:
            ids = self._keep(low, self._model(low))
        if word is not piece:
            ids += self[piece[-1]] if piece[-1] in self else self._keep(piece[-1], self._library(piece[-1]))
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text (null: none) as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        if self.bytes and not self._beyond(text):
            return b"".join(map(self.__getitem__, _BYTE_LEVEL.findall(text)))
        if self.bytes:  # only the runs with such characters are the library's
            runs = self._at_spaces(text)
            return b"".join([self._library(x) if self._beyond(x) else b"".join(map(self.__getitem__, _BYTE_LEVEL.findall(x))) for x in runs])
        if self.leading:
            return b"".join(map(self.__getitem__, self._at_spaces(text)))
        if not self.by_piece:
            return self._library(text)
        if self.spaced and "<|" not in text and not _OTHER.search(text):
            return self._space_out(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each path and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
