"""Byte-level BPE in linear time by backtracking, and decoding by an offset table.

Merges never cross words, so texts are cut into words as the library cuts them. In a word an Aho-Corasick automaton of all
tokens gives the longest token at each place. Tokens are taken greedily; a token stands only if the pair-compatibility
table lets it follow the one before: two tokens may be neighbours if, as both grow from bytes by merges in order of
rank, no pair that meets at their seam would have been merged first. If not, the next shorter token at the place is
tried, and if none is left the token before is given up and the place marked, so that no place is entered twice. A
sequence whose neighbours are all compatible is the only one that merging can give, so the ids are exact.

Decoding joins slices of one byte string that holds all tokens, with a table of offsets, and reads it as UTF-8 with U+FFFD
where it isn't. In every batch one short text is also encoded by the library; if it differed, its ids would be used.

Cases: null and empty texts have no ids and decode to the empty text; strings of special tokens in a text are their ids,
as in the library, or plain text if so asked; equal texts have equal results; long texts and long words are encoded
whole; an empty table gives no rows; null ids are kept; other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustmill.llm.common import CACHE_BYTES, slices
from trustmill.llm.tokens import SIGNS, WordEncoder, token_bytes

NEVER = 1 << 60
#: Pairs of tokens whose compatibility is kept; others are found again.
PAIRS = 1_000_000


class Merges:
    """What the merges of a vocabulary say about its tokens: how each came to be, its shorter prefix, who may follow whom."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocabulary.values()) + 1
        self.size = size
        self.rank, self.left, self.right = [NEVER] * size, list(range(size)), list(range(size))
        self.joined: dict[int, int] = {}
        for sign in SIGNS.values():
            if sign not in vocabulary:
                raise ValueError("a vocabulary with a token for every byte is needed")
            self.rank[vocabulary[sign]] = -1
        for rank, (a, b) in enumerate(merges):
            left, right, whole = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if max(self.rank[left], self.rank[right]) >= rank or self.rank[whole] < rank:
                raise ValueError("merges in the order in which they were learned, one for each token, are needed")
            self.rank[whole], self.left[whole], self.right[whole] = rank, left, right
            self.joined[left * size + right] = rank
        self.compatible: dict[int, bool] = {}

        made = {token: i for token, i in vocabulary.items() if self.rank[i] < NEVER}
        self.length = [0] * size
        self.shorter = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for token, i in sorted(made.items(), key=lambda x: len(x[0])):
            a, b = self.left[i], self.right[i]
            if a != i and not (self.length[a] and self.length[b] and self._may_follow(a, b, self.rank[i])):
                continue  # merges would give its bytes other tokens, so it never stands in a text
            self.length[i] = len(token)
            self.automaton.add_word(token, i)
            self.shorter[i] = next((k for n in range(len(token) - 1, 0, -1) if (k := made.get(token[:n], -1)) >= 0 and self.length[k]), -1)
        self.automaton.make_automaton()

    def _edge(self, token: int, side: list[int]) -> list[int]:
        out = [token]
        while side[out[-1]] != out[-1]:
            out.append(side[out[-1]])
        return out

    def _may_follow(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether a and b stay apart while merges of a rank below `before` are done."""
        rank, size = self.rank, self.size
        ends, begins = self._edge(a, self.right), self._edge(b, self.left)
        i, j = len(ends) - 1, len(begins) - 1
        while True:
            grow_a = rank[ends[i - 1]] if i else NEVER
            grow_b = rank[begins[j - 1]] if j else NEVER
            seam = self.joined.get(ends[i] * size + begins[j], NEVER)
            if seam < before and seam < grow_a and seam <= grow_b:  # of equal ranks the leftmost pair is merged first
                return False
            if not i and not j:
                return True
            if grow_a <= grow_b:
                i -= 1
            else:
                j -= 1

    def follows(self, a: int, b: int) -> bool:
        key = a * self.size + b
        known = self.compatible.get(key)
        if known is None:
            known = self._may_follow(a, b)
            if len(self.compatible) < PAIRS:
                self.compatible[key] = known
        return known

    def encode(self, word: str) -> list[int]:
        """Ids of a word written in byte signs."""
        length, shorter, follows = self.length, self.shorter, self.follows
        longest = array("i", bytes(4 * len(word)))
        for end, token in self.automaton.iter(word):
            longest[end + 1 - length[token]] = token  # later ends are longer tokens
        entered_in_vain = bytearray(len(word) + 1)
        out: list[int] = []
        at, token = 0, longest[0] if word else 0
        while at < len(word):
            end = at + length[token]
            if not entered_in_vain[end] and (not out or follows(out[-1], token)):
                out.append(token)
                at, token = end, longest[end] if end < len(word) else 0
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                entered_in_vain[at] = 1
                token = out.pop()
                at -= length[token]
        return out


class BacktrackingEncoder(WordEncoder):
    """Encodes and decodes with a byte-level vocabulary of the tokenizers library."""

    def __init__(self, path: str, special_as_text: bool = False, cache_bytes: int = CACHE_BYTES):
        super().__init__(path, cache_bytes)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, kind = told["model"], (told.get("pre_tokenizer") or {}).get("type")
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
        if kind != "ByteLevel" or told.get("normalizer") or any(odd) or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in told["added_tokens"]):
            raise ValueError("a byte-level vocabulary without normalisation is needed")
        self.library.encode_special_tokens = special_as_text
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {} if special_as_text else {x["content"]: x["id"] for x in told["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.merges = Merges(model["vocab"], [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]])
        tokens = token_bytes(self.library)
        self.tokens = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in tokens])])
        self.shown = list(map(str, range(self.size)))

    def _word(self, word: str) -> bytes:
        ids = self.merges.encode(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        if not text or not self.specials or not self.specials.search(text):
            return super().encode(text)
        parts = self.specials.split(text)
        return b"".join([struct.pack("<I", self.special[x]) if k % 2 else super(BacktrackingEncoder, self).encode(x) for k, x in enumerate(parts)])

    def decode(self, ids: np.ndarray) -> str:
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)
        return self.tokens[places].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model(path: str, special_as_text: bool = False) -> BacktrackingEncoder:
    return BacktrackingEncoder(path, special_as_text)


def encode_decode(docs: DataFrame, path: str, special_as_text: bool = False) -> DataFrame:
    """doc_id, ids and the text decoded from them, with their digests."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, special_as_text)
        for batch in it:
            for part in slices(batch):
                ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in m.checked(part.column("text").to_pylist())]
                decoded = list(map(m.decode, ids))
                written = [",".join(map(m.shown.__getitem__, x.tolist())).encode() for x in ids]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                columns = [
                    part.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).astype(np.int32))), pa.array(decoded, pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in written]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string, ids_sha256 string, decoded_sha256 string")
