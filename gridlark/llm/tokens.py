"""Token ids of whole texts by the tokenizers library, with a bounded memory of words.

Both public vocabularies first cut a text into words by a fixed pattern and then merge the bytes of each word on its
own. So a word that was met before needs no second encoding. Texts within Latin-1 (without its rare white space) are
cut here by the same pattern; any other text goes through the library's whole pipeline, and so does a text that has an
added token of the vocabulary, such as <|endoftext|>, written out.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: Words that a Python worker remembers, some 200 bytes each; at the limit it starts anew.
MEMORY = 1_200_000

# The classes of Latin-1 characters, and the word patterns that belong to the two vocabularies.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_NUMBER = "0-9²³¹¼½¾"
_SPACE = r" \t\n\x0b\x0c\r"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_WORDS = rf"{_ENDINGS}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_LOWER_WORDS = rf"{_ENDINGS}|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+"
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0]")


def vocabulary_path(name: str) -> str:
    """Where this machine keeps a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself if visible, else the next free one."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class Encoder:
    """``ids(text)`` equals the library's plain encoding, with nothing put around the text (add_special_tokens=False)."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.memory = memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.merge = self.whole.model.tokenize
        self.lower = self.whole.normalizer is not None
        self.cut = re.compile(_LOWER_WORDS if self.lower else _BYTE_WORDS).findall
        self.letters = _byte_letters()
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.flat, self.ends = array("I"), array("q", [0])

    def _learn(self, word: str) -> int:
        place = self.known[word] = len(self.ends) - 1
        if word.isascii() and word.isprintable():
            stood_in = word.replace(" ", self.letters[32])  # the others stand for themselves
        else:
            stood_in = "".join(map(self.letters.__getitem__, word.encode()))
        self.flat.extend([t.id for t in self.merge(stood_in)])
        self.ends.append(len(self.flat))
        return place

    def ids(self, text: str) -> np.ndarray:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._whole(text)
        if _ODD_SPACE.search(text) or any(a in text for a in self.added):
            return self._whole(text)
        if len(self.known) > self.memory:
            self._forget()
        found = self.cut(text.lower() if self.lower else text)
        known = self.known
        places = np.fromiter([known[w] if w in known else self._learn(w) for w in found], np.int64, len(found))
        return self._gather(places) if found else np.empty(0, np.uint32)

    def _gather(self, places: np.ndarray) -> np.ndarray:
        """The ids of words, one after the other. The views end with the call, so that the arrays can grow."""
        ends = np.frombuffer(self.ends, np.int64)
        starts = ends[places]
        sizes = ends[places + 1] - starts
        before = np.cumsum(sizes) - sizes
        return np.frombuffer(self.flat, np.uint32)[np.repeat(starts - before, sizes) + np.arange(sizes.sum())]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str, memory: int = MEMORY) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, memory)
