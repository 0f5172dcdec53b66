"""Cached encoding: whole texts are cut where no token can reach across, and each piece in the table is encoded once.

Both vocabularies cut a text into pre-tokens by a pattern, and no token reaches across a
cut, so the ids of a text are the ids of its pre-tokens, or of pieces between blanks, joined.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np

from .common import kept

#: Bytes in each of the two generations that one Python worker keeps, what an entry takes besides its texts, and pieces too long to keep.
CACHE_BYTES, ENTRY, LONG = 64 << 20, 150, 100

_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space to Python's re and str, but not to the tokenizer's pattern.
_ODD = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def split_words(text: str) -> list[str]:
    """For vocabularies that drop white space: pieces between blanks."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def split_spaced(text: str) -> list[str] | None:
    """For byte-level vocabularies: each run of non-blanks with at most one space before it."""
    return None if _ODD.search(text) else _PIECES.findall(text)


#: Letters, numbers and white space of Latin-1, as the vocabularies' patterns see them.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
#: The two vocabularies' own cutting into pre-tokens, for texts of Latin-1 only: their other characters don't occur there.
_PRETOKENS = {
    "split_words": re.compile(f"[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_N}]|[^{_S}{_L}{_N}]+"),
    "split_spaced": re.compile(f" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"),
}
LATIN_WORDS = _PRETOKENS["split_words"]


class Kept(dict):
    """string -> its ids' bytes, made where missing, in two generations: a full one becomes the old one.  Results don't depend on it."""

    def __init__(self, make: Callable[[str], bytes], most: int = CACHE_BYTES):
        super().__init__()
        self.make, self.most, self.old, self.size = make, most, {}, 0

    def keep(self, s: str, x: bytes) -> None:
        if len(s) <= LONG:
            self.size += len(s) + len(x) + ENTRY
            if self.size > self.most:
                self.old, self.size = dict(self), len(s) + len(x) + ENTRY
                self.clear()
            self[s] = x

    def __missing__(self, s: str) -> bytes:
        x = self.old.get(s)
        if x is None:
            x = self.make(s)
        self.keep(s, x)
        return x


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, through bounded tables of pre-tokens and pieces.

    A text of Latin-1 is cut into pre-tokens here, and each goes to the library's model in
    byte letters.  Other texts are cut at white space, and each piece goes through the
    library's whole path.  A text that holds an added token's string, or white space on
    which Python and the tokenizer differ, goes to the library whole.
    """

    def __init__(self, path: str, split: Callable[[str], list[str] | None]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() < 65536 else "<u4")
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.lower = split is split_words and '"Lowercase"' in self.tok.to_str()
        letters = byte_letters()
        self.bytes = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self.data = [int(i).to_bytes(self.kind.itemsize, "little") for i in range(max(self.tok.get_vocab().values()) + 1)]
        self.model, self.split, self.cut = self.tok.model, split, _PRETOKENS[split.__name__].findall
        self.pretokens, self.pieces = Kept(self._pretoken), Kept(self._whole)

    def _pretoken(self, word: str) -> bytes:
        data = self.data
        return b"".join([data[t.id] for t in self.model.tokenize(word.translate(self.bytes))])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def _bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.added is not None and self.added.search(text):
            return self._whole(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pieces = self.split(text)
            return self._whole(text) if pieces is None else b"".join(map(self.pieces.__getitem__, pieces))
        return b"".join(map(self.pretokens.__getitem__, self.cut(text.lower() if self.lower else text)))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null is empty."""
        return [np.frombuffer(self._bytes(t), self.kind) for t in texts]


def encoder(path: str, split: Callable) -> ChunkEncoder:
    """One encoder for each worker process, kept between tasks."""
    return kept(("chunks", path, split.__name__), lambda: ChunkEncoder(path, split))
