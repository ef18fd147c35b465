"""Token ids of whole texts, one cached word at a time.

Both vocabularies cut a text into words before any merge, and merges never cross words. The ids of a text are
therefore the ids of its words in order, and each distinct word is encoded once per Python worker by the
tokenizers library. The library's own normaliser and pre-tokenizer cut the texts, so that words begin and end where
its Unicode tables say; texts of characters below U+0180 alone are cut by the same patterns in Python, once a test has
shown that both cut all of these characters alike. The first short text of every batch is also encoded whole by the
library; should a text differ, the whole batch is encoded by the library.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from functools import lru_cache

from trustmill.llm.common import CACHE_BYTES, Cache

#: Characters below this are classified here, after a test that the library does so too.
SIMPLE = 0x180
SPACES = "\t-\r \x85\xa0"
LETTERS, DIGITS = ("".join(c for c in map(chr, range(SIMPLE)) if unicodedata.category(c)[0] == k) for k in "LN")
#: The word patterns of the two vocabularies, by whether words keep spaces.
WORDS = {
    True: rf"'(?:[stmd]|re|ve|ll)| ?(?:[{LETTERS}]+|[{DIGITS}]+|[^{SPACES}{LETTERS}{DIGITS}]+)|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+",
    False: rf"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{DIGITS}]|[^{SPACES}{LETTERS}{DIGITS}]+",
}


def _byte_signs() -> dict[int, str]:
    """The sign that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


SIGNS = _byte_signs()


def shown(word: str) -> str:
    return word.encode().decode("latin-1").translate(SIGNS)


def token_bytes(library) -> list[bytes]:
    """By id the bytes of each token of a byte-level vocabulary; special tokens are their text."""
    byte_of = {sign: b for b, sign in SIGNS.items()}
    vocabulary, out = library.get_vocab(), [b""] * library.get_vocab_size()
    for token, i in vocabulary.items():
        out[i] = bytes(map(byte_of.__getitem__, token)) if all(x in byte_of for x in token) else token.encode()
    return out


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Special tokens written out in a text are ordinary text. A text is cut at spaces
    first: what follows a space up to the next one has the same ids wherever it stands, unless white space touches it.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.cut = self.library.pre_tokenizer.pre_tokenize_str
        self.normalize = self.library.normalizer.normalize_str if self.library.normalizer else None
        self.keeps_spaces = self.library.normalizer is None
        self.size = self.library.get_vocab_size()
        self.words, self.parts = Cache(self._word, cache_bytes), Cache(self._part, cache_bytes)
        self.simple, self.is_simple = Cache(lambda word: self._word(shown(word)), cache_bytes), re.compile(f"[\0-{chr(SIMPLE - 1)}]*").fullmatch
        self.find = re.compile(WORDS[self.keeps_spaces]).findall
        probe = " ".join(f"a{x}b '{x}; 1{x}2 {x}  {x}{x}'{x}" for x in map(chr, range(SIMPLE)))
        words = self.cut(self.normalize(probe) if self.normalize else probe)
        self.finds = [shown(x) for x in self.find(probe.lower() if self.normalize else probe)] == [x for x, _ in words]

    def _word(self, word: str) -> bytes:
        ids = [x.id for x in self.library.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes | None:
        if not self.keeps_spaces:
            return self._plain(part)
        return None if not part or part[0].isspace() or part[-1].isspace() else self._plain(" " + part)

    def _plain(self, text: str) -> bytes:
        if self.finds and (text.isascii() or self.is_simple(text)):  # the normaliser only changes case and white space
            return b"".join(map(self.simple.__getitem__, self.find(text.lower() if self.normalize else text)))
        return b"".join([self.words[word] for word, _ in self.cut(self.normalize(text) if self.normalize else text)])

    def whole(self, text: str | None) -> bytes:
        """The library's own encoding of the whole text."""
        ids = self.library.encode(text or "", add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        first, *parts = text.split(" ")
        if self.keeps_spaces and (not first or first[-1].isspace()):
            return self._plain(text)
        try:
            return self._plain(first) + b"".join(map(self.parts.__getitem__, parts))
        except TypeError:  # white space of more than one character, which only the whole text can settle
            return self._plain(text)

    def checked(self, texts: list[str | None]) -> list[bytes]:
        """Ids of a batch of texts; if those of the first short one are not the library's, all are encoded by it."""
        out = [self.encode(x) for x in texts]
        first = next((k for k, x in enumerate(texts) if x and len(x) < 20_000), None)
        return out if first is None or self.whole(texts[first]) == out[first] else [self.whole(x) for x in texts]


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
