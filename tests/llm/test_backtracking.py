import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trustmill.llm import backtracking
from trustmill.llm.tokens import shown

from .conftest import ODD_TEXTS

BYTE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(BYTE)
some_text = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'aethoxX-=0")), max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", " ", "a", "<|", "\n"])).map("".join)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(some_text)
def test_ids_and_texts_equal_the_librarys(text):
    m = backtracking.model(BYTE)
    ids = np.frombuffer(m.encode(text), "<u4").astype(np.int64)
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert m.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_any_ids_decode_as_in_the_library(ids):
    assert backtracking.model(BYTE).decode(np.array(ids, np.int64)) == LIBRARY.decode(ids, skip_special_tokens=False)


def merged(word, ranks):
    """Merging as it is defined: the pair of the lowest rank, leftmost first, until none is left."""
    parts = list(word)
    while found := min(((ranks[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in ranks), default=None):
        parts[found[1] : found[1] + 2] = ["".join(parts[found[1] : found[1] + 2])]
    return parts


def test_small_vocabularies_against_merging():
    """Vocabularies in which the longest token is often wrong, so that tokens are given up."""
    r = random.Random(3)
    from trustmill.llm.tokens import SIGNS

    for _ in range(60):
        vocabulary = {s: i for i, s in enumerate(SIGNS.values())}
        ranks = {}
        for _ in range(r.randint(1, 25)):
            a, b = r.choice(["a", "b", "c", *(x for x in vocabulary if len(x) > 1)]), r.choice(["a", "b", "c", *(x for x in vocabulary if len(x) > 1)])
            if a + b not in vocabulary and len(a + b) < 9:
                ranks[a, b] = len(ranks)
                vocabulary[a + b] = len(vocabulary)
        m = backtracking.Merges(vocabulary, list(ranks))
        shown_as = {i: s for s, i in vocabulary.items()}
        for _ in range(60):
            word = "".join(r.choice("abc") for _ in range(r.randint(0, 30)))
            assert [shown_as[i] for i in m.encode(word)] == merged(word, ranks)


@pytest.mark.parametrize("word", ["x" * 300_000, "ab" * 100_000, "-" * 99_999, "日" * 50_000])
def test_long_words_take_linear_time(word):
    m = backtracking.model(BYTE)
    assert m.merges.encode(shown(word)) == [x.id for x in m.library.model.tokenize(shown(word))]


def test_merges_out_of_order_are_refused():
    from trustmill.llm.tokens import SIGNS

    vocabulary = {s: i for i, s in enumerate([*SIGNS.values(), "ab", "abc"])}
    with pytest.raises(ValueError, match="order"):
        backtracking.Merges(vocabulary, [("ab", "c"), ("a", "b")])


def test_rows(odd, empty, spark, sf_dir):
    rows = backtracking.encode_decode(odd, BYTE).collect()
    assert len(rows) == odd.count() and backtracking.encode_decode(empty, BYTE).count() == 0
    by = {r.doc_id: r for r in rows if r.doc_id not in (0, None)}
    for i, text in list(enumerate(ODD_TEXTS))[1:]:
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert (by[i].ids, by[i].n_tokens, by[i].ids_sha256) == (ids, len(ids), sha(",".join(map(str, ids))))
        assert by[i].decoded == text and by[i].decoded_sha256 == sha(text)
    plain = {r.doc_id: r.ids for r in backtracking.encode_decode(odd, BYTE, special_as_text=True).collect()}
    at = ODD_TEXTS.index("<|endoftext|> <s>")
    assert 50256 in by[at].ids and 50256 not in plain[at]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in backtracking.encode_decode(docs, BYTE).select("doc_id", "ids_sha256", "decoded_sha256").collect():
        ids = LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.ids_sha256, r.decoded_sha256) == (sha(",".join(map(str, ids))), sha(texts[r.doc_id]))


def test_no_text_needs_the_librarys_ids(spark, sf_dir):
    m = backtracking.model(BYTE)
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect():
        assert m.encode(r.text) == m.whole(r.text)
