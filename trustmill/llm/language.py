"""Language identification by cross-parsing: the language whose sample text explains a text in the fewest phrases.

For each language a suffix automaton holds every substring of a sample of labelled text. A text is parsed from left to
right into longest matches of that automaton; the number of phrases times the bits that point to one place in the
sample estimates the cross entropy, and the language with the least wins.

Letters are lower-cased, everything else is one sign between words; signs are the bytes of UTF-8, so that no letter of
any script is merged with another. Every sign of every text is parsed, in one parse from its beginning to its end:
stretches of BLOCK signs are parsed side by side in numpy, and then again from the state in which the stretch before
them ended, until both parses are in one state; this changes the time and not the phrases.

Learned are only labelled documents whose crc32 of the id is no multiple of 5, of any length: of each language the
SAMPLE_DOCS shortest-hash ones, of a document of more than DOC_CHARS characters so many from a hashed place on, together
at most SAMPLE_SIGNS signs a language and ALL_SIGNS signs for all languages. These bounds hold the model only.

Cases: null texts and texts without a letter are `und` with score 0, as is everything if nothing could be learned;
equal texts have equal results; ties go to the language that sorts first; null ids are scored as others and never
learned from; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustmill.llm.common import held_out, in_training

SAMPLE_DOCS, DOC_CHARS, SAMPLE_SIGNS, ALL_SIGNS = 60, 1000, 32_000, 640_000
#: Signs of a stretch, and signs parsed at once, a multiple of that (a longer text goes on from where the last part ended).
BLOCK, PART = 256, 1 << 22
#: More phrases a sign than this, in so many signs at least, and a text is in none of the languages.
FAR, FAR_SIGNS = 0.75, 40


def automaton(signs: list[int], width: int) -> np.ndarray:
    """The suffix automaton as a flat table: at state * width + sign the next state times width, plus 1 if a phrase
    begins with the sign, because no match goes on with it or because the state is 0, between phrases. A sign that the
    sample lacks is a phrase of its own; the last sign is the padding, which begins nothing."""
    nxt: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in signs:
        cur = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    table = np.ones((len(nxt), width), np.int32)
    for c, s in nxt[0].items():
        table[:, c] = s * width + 1
    at = np.repeat(np.arange(1, len(nxt)), [len(row) for row in nxt[1:]])
    table[at, [c for row in nxt[1:] for c in row]] = np.array([s for row in nxt[1:] for s in row.values()], np.int32) * width
    table[:, width - 1] = 0
    return table.ravel()


@lru_cache(maxsize=1)
def letter_code() -> np.ndarray:
    """For each character the lower-case letter it stands for, 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def signs(text: str) -> np.ndarray:
    """The bytes of the lower-case letters of a text; everything between two of its words is one 0."""
    codes = letter_code()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if len(codes):
        codes = codes[(codes > 0) | np.r_[False, codes[:-1] > 0]]
    return np.frombuffer(codes.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)


class Automaton:
    """Longest matches in one sample."""

    def __init__(self, sample: np.ndarray):
        own = np.unique(sample)
        width = 4
        while width < len(own) + 2:
            width *= 2
        self.sign = np.full(256, width - 2, np.uint16)  # a sign that the sample lacks
        self.sign[own] = np.arange(len(own))
        self.nothing, self.mask = width - 1, np.int32(-width)
        self.table = automaton(self.sign[sample].tolist(), width)
        self.bits = np.log2(max(2, len(sample)))

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """The number of phrases of each text, given as signs."""
        out, state, done = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int32), 0
        part, size = [], 0
        for k, text in enumerate(texts):
            for at in range(0, len(text), PART):
                piece = text[at : at + PART]
                if size and size + len(piece) > PART:
                    self._parse(part, out, state)
                    part, size = [], 0
                part.append((k, piece))
                size += len(piece)
        if part:
            self._parse(part, out, state)
        return out

    def _parse(self, part: list[tuple[int, np.ndarray]], out: np.ndarray, state: np.ndarray) -> None:
        """Adds the phrases of pieces of texts to out, going on from each text's state."""
        own = np.array([k for k, _ in part])
        blocks = -(-np.array([len(x) for _, x in part]) // BLOCK)
        first = np.r_[0, np.cumsum(blocks)]
        lanes = np.full((int(first[-1]), BLOCK), self.nothing, np.uint16)
        for k, (_, x) in enumerate(part):
            lanes[first[k] : first[k + 1]].ravel()[: len(x)] = self.sign[x]
        steps = np.ascontiguousarray(lanes.T).astype(np.int32)
        n = len(lanes)
        at = np.zeros(n, np.int32)
        at[first[:-1]] = state[own]
        given, begun = at, np.zeros(n, np.int32)
        states, counts = np.empty((BLOCK, n), np.int32), np.empty((BLOCK, n), np.uint16)
        for k, step in enumerate(steps):
            found = self.table.take(at | step)
            begun += found & 1
            at = found & self.mask
            states[k], counts[k] = at, begun
        inner, again = np.ones(n, bool), np.zeros(n, bool)
        inner[first[:-1]] = False
        total, end = begun, states[-1].copy()
        # stretches that the one before them enters in another state, until there is none; from where a stretch comes
        # to a state of its first parse the rest of that parse holds
        while len(rows := np.flatnonzero(inner & (np.r_[0, end[:-1]] != given))):
            given = given.copy()
            given[rows] = at = end[rows - 1]
            first_time, begun = ~again[rows], np.zeros(len(rows), np.int32)
            again[rows] = True
            for k, step in enumerate(steps):
                found = self.table.take(at | step[rows])
                begun += found & 1
                at = found & self.mask
                met = first_time & (at == states[k, rows])
                if met.any():
                    total[rows[met]] += begun[met] - counts[k, rows[met]]
                    left = ~met
                    rows, at, begun, first_time = rows[left], at[left], begun[left], first_time[left]
                    if not len(rows):
                        break
            total[rows], end[rows] = begun, at
        np.add.at(out, np.repeat(own, blocks), total)
        state[own] = end[first[1:] - 1]


class Languages:
    """Automata of a few languages, from their sample texts."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        most = min(SAMPLE_SIGNS, ALL_SIGNS // max(1, len(samples)))
        self.known = [Automaton(signs(samples[name])[:most]) for name in self.names]
        self.bits = np.array([a.bits for a in self.known])

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases [text, language] and the number of signs of each text."""
        own = [signs(x or "") for x in texts]
        out = np.zeros((len(texts), len(self.names)), np.int64)
        for k, known in enumerate(self.known):
            out[:, k] = known.phrases(own)
        return out, np.array([len(x) for x in own], np.int64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Languages, scores, and whether a text is in none of them: without letters, or with phrases hardly longer than
        a sign in every language."""
        lettered = np.array([bool(x) and any(map(str.isalpha, x)) for x in texts], bool)
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts), (~lettered).tolist()
        counts, sizes = self.phrases(texts)
        bits = counts * self.bits
        best = bits.argmin(axis=1)
        worse = np.minimum((bits - bits.min(axis=1, keepdims=True)) / 8, 60)
        score = np.where(lettered, np.round(1 / np.exp2(-worse).sum(axis=1), 9), 0.0)
        far = (sizes >= FAR_SIGNS) & (counts.min(axis=1) > FAR * sizes)
        return [self.names[b] if x else "und" for b, x in zip(best, lettered, strict=True)], score.tolist(), (far | ~lettered).tolist()


@lru_cache(maxsize=2)
def languages(samples: tuple[tuple[str, str], ...]) -> Languages:
    return Languages(dict(samples))


def learn(docs: DataFrame) -> tuple[tuple[str, str], ...]:
    """A bounded sample of text for each language."""
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    place = F.when(F.length("text") > DOC_CHARS, 1 + F.pmod(F.xxhash64("doc_id", F.lit("place")), F.length("text") - DOC_CHARS + 1)).otherwise(1).cast("int")
    labelled = docs.where(F.col("lang").isNotNull() & in_training() & F.col("text").isNotNull()).select("doc_id", "lang", F.substring("text", place, F.lit(DOC_CHARS)).alias("text"))
    rows = labelled.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= SAMPLE_DOCS).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return tuple((k, " ".join(v)) for k, v in sorted(samples.items()) if any(map(str.isalpha, "".join(v))))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...]) -> DataFrame:
    """The documents with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = languages(shared.value)
        for batch in it:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                names, scores, _ = known.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def predictions(docs: DataFrame) -> DataFrame:
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def kept(docs: DataFrame, samples: tuple[tuple[str, str], ...]) -> DataFrame:
    """The rows whose language could be told, all their columns as they are: those with a letter that are not far from
    every language learned. How many languages there are makes no difference, and if none was learned all with a
    letter stay. Null and empty texts go."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    text = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = languages(shared.value)
        for batch in it:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                _, _, untold = known.predict(part.column(text).to_pylist())
                yield part.filter(pa.array([not x for x in untold], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
