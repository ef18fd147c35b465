"""Toxicity by the nearest labelled examples under TF-IDF cosine, found exactly with a block-max inverted index.

Learned from a bounded sample: the EXAMPLES labelled documents (crc32 of the id no multiple of 5) with the smallest id
hashes. Terms are all words in at least two of them. Each example is a unit vector of (1 + ln tf) * idf * chi2 over
these terms, where chi2 is the statistic of the word's presence against the label: a factor without any cutoff, which
lets words that depend on the label outweigh the others at every size of the sample. The index holds, for each term, the
examples' weights and their maximum in each block of BLOCK examples. A text's terms are added until the rest cannot bring
another example among the K nearest; of the examples met those whose block's maxima can are computed in full. Their labels, weighted by cosine and drawn
towards the share of toxic examples by PRIOR votes, are the score; the examples are the evidence.

Cases: a text without any term (null and empty ones too) has no neighbour and gets the share of toxic examples, or 0 if
there are no examples; equal texts have equal scores; equal cosines are ordered by example id; an id with
several labels is learned once for each; null ids are scored as others and never learned from; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustmill.llm.common import held_out, in_training, stored

EXAMPLES, BLOCK, K, PRIOR = 20_000, 64, 31, 1.0
#: Terms with a row over all examples (of 4 bytes each), queries that are added to these at once, and how far sums of rounded weights may be off.
DENSE, TOGETHER, SLACK = 400, 128, 1e-5
#: The least sum above 0.
TINY = float(np.finfo(np.float32).tiny)
#: Results a worker remembers.
CACHED = 4_000
#: Examples that predictions shows as evidence; score gives all of them.
SHOWN = 5
#: A word, in Java's and in Python's regular expressions alike.
NO_WORD = r"[\x00-\x26\x28-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NO_WORD), lambda w: w != "")


def example_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic and words of the sample (at most EXAMPLES rows)."""
    known = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("id"), "toxic").distinct()
    picked = known.where(in_training("id")).orderBy(F.xxhash64("id"), "id", "toxic").limit(EXAMPLES)
    texts = docs.select("doc_id", "text")
    return texts.join(F.broadcast(picked), texts["doc_id"] == picked["id"]).select("id", "toxic", words(F.coalesce("text", F.lit(""))).alias("words"))


class BlockMaxIndex:
    """Exact nearest neighbours by cosine among sparse unit vectors. vectors: (id, label, {term: weight}), by id."""

    def __init__(self, vectors: list[tuple[int, int, dict[int, float]]], block: int = BLOCK):
        at = np.repeat(np.arange(len(vectors)), [len(v[2]) for v in vectors])
        entries = [e for v in vectors for e in sorted(v[2].items())]
        self._fill([v[0] for v in vectors], [v[1] for v in vectors], at, np.array([t for t, _ in entries], np.int32), np.array([w for _, w in entries], np.float64), block)

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, at: np.ndarray, term: np.ndarray, weight: np.ndarray, block: int = BLOCK) -> BlockMaxIndex:
        """From the vectors' entries: position, term and weight."""
        index = cls.__new__(cls)
        index._fill(ids, labels, at, term, weight, block)
        return index

    def _fill(self, ids, labels, at: np.ndarray, term: np.ndarray, weight: np.ndarray, block: int) -> None:
        """Entries are sorted by position and then term. Copies are dropped as soon as they are not needed."""
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, np.float64)
        n = len(self.ids)
        self.block, self.blocks = block, -(-n // block)
        bounds = np.searchsorted(at, np.arange(n + 1))
        # vectors that lean on few terms stand together, so that blocks differ in their maxima
        top = np.zeros(n)
        given = np.flatnonzero(bounds[1:] > bounds[:-1])
        if len(given):
            top[given] = np.maximum.reduceat(weight, bounds[given])
        self.own = np.argsort(-top, kind="stable")
        lo, hi = bounds[self.own], bounds[self.own + 1]
        order = _ranges(lo, hi)
        self.row = np.append(0, np.cumsum(hi - lo))
        self.row_term, self.row_weight = term[order].astype(np.int32), weight[order]
        del order, at, term, weight
        order = np.argsort(self.row_term, kind="stable")
        term = self.row_term[order]
        self.weight = self.row_weight[order].astype(np.float32)
        self.at = np.repeat(np.arange(n, dtype=np.int32), hi - lo)[order]
        del order
        # entries: runs of one term in one block, with their greatest weight
        own = self.at // block
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (own[1:] != own[:-1])]) if len(term) else np.empty(0, np.int64)
        self.entry_block = own[first].astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, first).astype(np.float64) if len(first) else np.empty(0)
        self.terms = int(term[-1]) + 1 if len(term) else 0
        self.entries = np.searchsorted(term[first], np.arange(self.terms + 1))
        self.postings = np.searchsorted(term, np.arange(self.terms + 1))
        self.term_most = np.zeros(self.terms)
        np.maximum.at(self.term_most, term[first], self.most)
        self.query = np.zeros(self.terms)
        # the most frequent terms also as rows over all vectors, which are faster to add (rounded, see SLACK)
        often = np.argsort(-np.diff(self.postings), kind="stable")[:DENSE]
        self.dense_row = np.full(self.terms, -1, np.int32)
        self.dense_row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n), np.float32)
        for k, t in enumerate(often.tolist()):
            own = slice(self.postings[t], self.postings[t + 1])
            self.dense[k, self.at[own]] = self.weight[own]

    def _cosines(self, rows: np.ndarray) -> np.ndarray:
        """Of some vectors with the query."""
        if not len(rows):
            return np.empty(0)
        own, size = _ranges(self.row[rows], self.row[rows + 1]), self.row[rows + 1] - self.row[rows]
        return np.add.reduceat(self.query[self.row_term[own]] * self.row_weight[own], np.cumsum(size) - size)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> list[list[tuple[int, float]]]:
        """For each query, unit vectors as terms and weights, (position, cosine) of the k nearest with a cosine above 0;
        equal cosines by position. The most frequent terms are added for many queries at once."""
        out = []
        for lo in range(0, len(queries), TOGETHER):
            part = [(t[t < self.terms], w[t < self.terms]) for t, w in queries[lo : lo + TOGETHER]]
            often = np.zeros((len(part), len(self.dense)), np.float32)
            rare = []
            for i, (t, w) in enumerate(part):
                row = self.dense_row[t]
                often[i, row[row >= 0]] = w[row >= 0]
                rare.append((t[row < 0], w[row < 0]))
            scores = often @ self.dense
            out += [self._nearest(*whole, *own, score, k) for whole, own, score in zip(part, rare, scores, strict=True)]
        return out

    def _nearest(self, whole: np.ndarray, weights: np.ndarray, term: np.ndarray, weight: np.ndarray, score: np.ndarray, k: int) -> list[tuple[int, float]]:
        """The rare terms of a query are added to its scores in the order of the most that they can give, until what the
        rest can give is less than the k-th cosine so far: a vector without any of the terms added is not among the
        nearest. Of the others those stay whose cosine so far and the maxima of the rest in their block reach it; their
        cosines are computed in full."""
        most = weight * self.term_most[term]
        order = np.argsort(-most, kind="stable")
        term, weight = term[order], weight[order]
        left = np.append(np.cumsum(most[order][::-1])[::-1], 0.0)
        reached, done = float(np.partition(score, -k)[-k]) if len(score) >= k else 0.0, 0
        # further terms are added while more than 2 k vectors could still be among the nearest, which would cost more
        while done < len(term) and (left[done] >= reached - SLACK or np.count_nonzero(score >= reached - left[done]) > 2 * k):
            goal = min(left[done] / 16, max(reached - 2 * SLACK, 0.0))
            take = min(len(term), max(done + 1, int(np.searchsorted(-left, -goal))))
            lo, hi = self.postings[term[done:take]], self.postings[term[done:take] + 1]
            own = _ranges(lo, hi)
            score += np.bincount(self.at[own], np.repeat(weight[done:take], hi - lo) * self.weight[own], minlength=len(score)).astype(np.float32)
            done = take
            if len(score) >= k:  # the k-th is among those that reach the k-th before
                reached = float(np.partition(score[score >= reached], -k)[-k])
        lo, hi = self.entries[term[done:]], self.entries[term[done:] + 1]
        entry = _ranges(lo, hi)
        rest = np.bincount(self.entry_block[entry], np.repeat(weight[done:], hi - lo) * self.most[entry], minlength=self.blocks)
        # only vectors that the greatest rest could bring that far need their block's
        near = np.flatnonzero(score >= max(reached - SLACK - float(rest.max(initial=0.0)), TINY))
        bound = score[near] + rest[near // self.block]
        fits = bound >= reached - SLACK
        near, bound = near[fits], bound[fits]
        self.query[whole] = weights
        # those with the greatest cosines so far raise the floor for the others, and of these the greatest bounds first
        order = np.argsort(-score[near], kind="stable")
        others, bound = near[order[k:]], bound[order[k:]]
        near = near[order[:k]]
        cosine = self._cosines(near)
        order = np.argsort(-bound, kind="stable")
        others, bound = others[order], bound[order]
        while len(others) and (fit := int(np.searchsorted(-bound, SLACK - np.partition(cosine, -k)[-k], side="right"))):
            others, bound = others[:fit], bound[:fit]
            near, cosine, others, bound = np.concatenate([near, others[:k]]), np.concatenate([cosine, self._cosines(others[:k])]), others[k:], bound[k:]
        self.query[whole] = 0.0
        cosine, at = np.round(cosine, 12), self.own[near]
        best = np.lexsort((at, -cosine))[:k]
        return [(p, c) for p, c in zip(at[best].tolist(), cosine[best].tolist(), strict=True) if c > 0]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges lo..hi-1, one after the other."""
    size = hi - lo
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum())) if len(lo) else np.empty(0, np.int64)


class ToxicityModel:
    """Terms, index and votes. examples: ids, labels, numbers of terms, terms and their counts, as bytes."""

    def __init__(self, terms: str, factor: bytes, examples: tuple[bytes, ...], share: float):
        self.numbers = {t: k for k, t in enumerate(terms.split("\n") if terms else [])}
        self.factor = np.frombuffer(factor, np.float64)
        self.share = share
        ids, labels, sizes = (np.frombuffer(x, np.int64) for x in examples[:3])
        term, count = (np.frombuffer(x, np.int32) for x in examples[3:])
        at = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        raw = np.log(count)
        raw += 1
        raw *= self.factor[term]
        raw /= np.sqrt(np.bincount(at, raw * raw, minlength=len(ids)))[at]
        self.index = BlockMaxIndex.of(ids, labels, at, term, raw)
        self.votes: dict[bytes, tuple[float, list[tuple[int, float]]]] = {}
        self.split = re.compile(NO_WORD).split

    def score(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, float]]]]:
        """The scores, and their evidence: ids and cosines of the nearest examples."""
        found, new = [], {}
        for text in texts:
            term, count = counted(self.split((text or "").lower()), self.numbers)
            key = hashlib.sha256(term.tobytes() + count.tobytes()).digest()
            found.append(key)
            if key not in self.votes and key not in new:
                raw = (1 + np.log(count)) * self.factor[term]
                norm = math.sqrt(float(raw @ raw))
                new[key] = (term, raw / norm) if norm else (term[:0], raw[:0])
        votes = dict(zip(new, map(self._vote, self.index.nearest(list(new.values()))), strict=True))
        out = [votes.get(key) or self.votes[key] for key in found]
        for key, vote in votes.items():
            if len(self.votes) < CACHED:
                self.votes[key] = vote
        return out

    def _vote(self, near: list[tuple[int, float]]) -> tuple[float, list[tuple[int, float]]]:
        weight = sum(c for _, c in near)
        toxic = sum(c * self.index.labels[i] for i, c in near)
        return round(float((toxic + PRIOR * self.share) / (weight + PRIOR)), 9), [(int(self.index.ids[i]), c) for i, c in near]


def counted(words: list[str], numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the known words in order, and their counts."""
    count = Counter(words)
    term = np.fromiter(map(numbers.get, count, repeat(-1)), np.int32, len(count))
    number, order = np.fromiter(count.values(), np.int32, len(count)), np.argsort(term)
    order = order[np.searchsorted(term[order], 0) :]
    return term[order], number[order]


def learn(docs: DataFrame, labels: DataFrame) -> tuple:
    """Terms and their factors, examples with the counts of their terms, and the share of toxic ones: all bounded."""
    rows = stored(example_rows(docs, labels), "toxicity-examples")
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n:
        return "", b"", (b"",) * 5, 0.0
    found = rows.select("toxic", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("toxic").alias("a"))
    a, df = F.col("a").cast("double"), F.col("df").cast("double")
    spread = df * (n - df) * toxic * (n - toxic)
    chi2 = F.when(spread > 0, n * F.pow(a * n - df * toxic, 2) / spread).otherwise(0.0)
    table = found.where("df >= 2").select("word", "df", chi2.alias("chi2")).where("chi2 > 0").toArrow().sort_by("word")
    terms = table.column("word").to_pylist()
    factor = (np.log(n / table.column("df").to_numpy()) + 1) * table.column("chi2").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast("\n".join(terms))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {t: k for k, t in enumerate(shared.value.split("\n") if shared.value else [])}
        for batch in it:
            pairs = [counted(w, numbers) for w in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), *(pa.array([x[k].tobytes() for x in pairs], pa.binary()) for k in (0, 1))], ["id", "toxic", "term", "n"])

    read = rows.select(F.col("id").cast("long").alias("id"), F.col("toxic").cast("long").alias("toxic"), "words")
    examples = read.mapInArrow(count, "id long, toxic long, term binary, n binary").where(F.length("term") > 0).toArrow().sort_by([("id", "ascending"), ("toxic", "ascending")])
    ids, label = (examples.column(k).to_numpy().astype(np.int64).tobytes() for k in ("id", "toxic"))
    term, counts = (examples.column(k).to_pylist() for k in ("term", "n"))
    return "\n".join(terms), factor.tobytes(), (ids, label, np.array([len(x) // 4 for x in term], np.int64).tobytes(), b"".join(term), b"".join(counts)), toxic / n


#: The one model that a worker holds, by the key of its broadcast.
_held: dict[str, ToxicityModel] = {}


def _model(key: str, value: Callable[[], tuple]) -> ToxicityModel:
    if key not in _held:
        _held.clear()
        _held[key] = ToxicityModel(*value())
    return _held[key]


def score(docs: DataFrame, learned: tuple) -> DataFrame:
    """doc_id, score, and the nearest examples as evidence."""
    key = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(key, lambda: shared.value)
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = model.score(part.column(1).to_pylist())
                evidence = pa.array([[{"doc_id": i, "cosine": c} for i, c in e] for _, e in found], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s for s, _ in found], pa.float64()), evidence], ["doc_id", "score", "evidence"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double>>")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and the SHOWN nearest examples."""
    found = score(docs, learn(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.slice("evidence", 1, SHOWN).alias("evidence"))
