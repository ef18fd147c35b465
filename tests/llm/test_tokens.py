import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trustmill.llm import packing, sentencepieces, token_files
from trustmill.llm.tokens import encoder

from .conftest import ODD_TEXTS

BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ascii_text = st.text(st.one_of(st.characters(max_codepoint=0x17F), st.sampled_from(" '\n\tst1")), max_size=30)
some_text = ascii_text | st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t ▁'aetho")), max_size=40)


@settings(max_examples=150, deadline=None)
@given(some_text)
def test_ids_equal_the_libraries(text):
    for path in (BYTE, WORD):
        e = encoder(path)
        assert e.encode(text) == e.whole(text)
    m = sentencepieces.model(PIECE)
    shown, ids = m.encode(text)
    assert ids == m.library.encode(text) and shown == ",".join(map(str, ids))
    assert m.decode(ids) == m.library.decode(ids)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_equal_the_librarys_at_code_points(path):
    """Letters, digits and signs as the library's tables have them: code points between letters, digits and signs (all up
    to U+1000, every 67th beyond; all of them take minutes and passed too)."""
    e = encoder(path)
    assert e.finds
    points = [*range(0x1000), *range(0x1000, 0xD800, 67), *range(0xE000, 0x110000, 67)]
    for lo in range(0, len(points), 97):
        signs = [chr(c) for c in points[lo : lo + 97]]
        text = " ".join(f"a{x}b :{x}; 1{x}2 {x} {x}{x}" for x in signs)
        assert e.encode(text) == e.whole(text), points[lo]


@pytest.mark.parametrize("text", [":\U0003d000", "a:\u0558", "\u058b.", "x\ua7ce1", "A\u0300 \u0301e  \u180e x\x1c\x1c y\x85 z"])
def test_characters_on_which_libraries_differ(spark, text):
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: bytes(r.ids) for r in token_files.read(*token_files.write(docs, WORD)).collect()}
    assert rows == {i: encoder(WORD).whole(x) + np.array([1], "<u4").tobytes() for i, x in ((1, text), (2, None))}
    assert encoder(BYTE).encode(text) == encoder(BYTE).whole(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=10))
def test_any_ids_decode_as_in_the_library(ids):
    m = sentencepieces.model(PIECE)
    assert m.decode(ids) == m.library.decode(ids)


def test_agenda_takes_best_score_then_leftmost():
    scores = {"aa": -1.0, "ab": -2.0, "aab": -3.0}
    assert sentencepieces.agenda_merge(list("aaab"), scores) == ["aa", "ab"]
    assert sentencepieces.agenda_merge(list("aaa"), scores) == ["aa", "a"]
    assert sentencepieces.agenda_merge([], scores) == []


def test_both_forms_of_the_agenda_agree(monkeypatch):
    r = random.Random(8)
    for _ in range(300):
        pieces = {"".join(r.choice("abc") for _ in range(r.randint(2, 4))): -r.randrange(6) / 2 for _ in range(r.randint(0, 14))}
        word = [r.choice("abc") for _ in range(r.randint(0, 20))]
        listed = sentencepieces.agenda_merge(list(word), pieces)
        with monkeypatch.context() as m:
            m.setattr(sentencepieces, "SHORT", -1)
            assert sentencepieces.agenda_merge(list(word), pieces) == listed


def test_agendas_in_one_array_agree_with_single_ones():
    r = random.Random(9)
    for _ in range(100):
        pieces = {"".join(r.choice("abc") for _ in range(r.randint(1, 4))): -r.randrange(6) / 2 for _ in range(r.randint(0, 14))}
        table = sentencepieces.PairTable(pieces, pieces)
        words = ["".join(r.choice("abcd😀") for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 40))]
        symbols, bounds = table.merge(words)
        shown = [table.symbols[i] if i < len(table.symbols) else chr(i - len(table.symbols)) for i in symbols.tolist()]
        assert [shown[a:b] for a, b in zip(bounds, bounds[1:])] == [sentencepieces.agenda_merge(list(x), pieces) for x in words]


@settings(max_examples=60, deadline=None)
@given(st.lists(some_text | st.none(), min_size=1, max_size=12), st.sampled_from([1, 10**9]), st.sampled_from([4, 10**9]), st.integers(0, 2))
def test_texts_encoded_together_equal_the_librarys(texts, many, together, skipped):
    m = sentencepieces.PieceModel.__new__(sentencepieces.PieceModel)
    m.__dict__ |= sentencepieces.model(PIECE).__dict__ | {"words": {}, "room": 2000}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sentencepieces, "MANY", many)
        patch.setattr(sentencepieces, "ROWS", 3)
        patch.setattr(sentencepieces, "TOGETHER", together)
        ids, bounds = m.encode_texts(pa.array([None, "x y"][:skipped] + texts, pa.string())[skipped:])
        want = [m.library.encode(x or "") for x in texts]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
        assert m.decode_texts(ids, bounds) == m.library.decode(want)
        assert [bytes(x).decode() for x in m.decimals(ids, bounds)] == [",".join(map(str, x)) for x in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=10), min_size=1, max_size=6))
def test_any_ids_decoded_together_equal_the_librarys(lists):
    m = sentencepieces.model(PIECE)
    ids = np.array([i for x in lists for i in x], np.int32)
    assert m.decode_texts(ids, np.cumsum([0, *map(len, lists)])) == m.library.decode(lists)


def test_new_words_of_a_batch_share_one_agenda(spark, monkeypatch):
    """Many short words that are new are not merged one by one in Python."""
    texts = [" ".join(f"word{k}x{i}\n" for k in range(40)) for i in range(8)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(8)), "text": texts})
    fresh, single, runs = sentencepieces.PieceModel(PIECE), [], []
    monkeypatch.setattr(sentencepieces, "model", lambda path: fresh)
    merge = sentencepieces.agenda_merge
    monkeypatch.setattr(sentencepieces, "agenda_merge", lambda *x: single.append(x) or merge(*x))
    docs = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(run))
    sentencepieces.encode_decode(docs, PIECE)
    rows = [r for b in runs[0](iter([batch])) for r in b.to_pylist()]
    assert [r["ids"] for r in rows] == fresh.library.encode(texts) and not any(r["by_library"] for r in rows) and not single


def test_sentencepiece_rows(odd, empty):
    rows = sentencepieces.encode_decode(odd, PIECE).collect()
    assert len(rows) == odd.count() and sentencepieces.encode_decode(empty, PIECE).count() == 0
    by = {r.doc_id: r for r in rows if r.doc_id not in (0, None)}
    library = sentencepieces.model(PIECE).library
    for i, text in list(enumerate(ODD_TEXTS))[1:]:
        ids = library.encode(text)
        assert (by[i].n_tokens, by[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert by[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_token_files_round_trip(odd, empty):
    blocks, dictionary = token_files.write(odd, WORD, end_id=1)
    rows = token_files.read(blocks, dictionary).collect()
    assert len(rows) == odd.count()
    e, start = encoder(WORD), 0
    end = np.array([1], "<u4").tobytes()
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == start and r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.n_tokens * 4 == len(r.ids)
        start += r.n_tokens
        if r.doc_id not in (0, None):
            assert bytes(r.ids) == e.whole(ODD_TEXTS[r.doc_id]) + end
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x))
    few = {r.doc_id: r.ids for r in token_files.read_documents(blocks, dictionary, [3, 5]).collect()}
    assert few == {i: np.frombuffer(e.whole(ODD_TEXTS[i]) + end, "<u4").tolist() for i in (3, 5)}
    with pytest.raises(Exception, match="another dictionary"):
        token_files.read(blocks, b"other").collect()
    blocks, dictionary = token_files.write(empty, WORD)
    assert token_files.read(blocks, dictionary).count() == 0


def test_ids_wider_than_the_format_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="do not fit"):
        token_files.write(docs, WORD, width=1)
    blocks, dictionary = token_files.write(docs, WORD, end_id=70_000)
    assert np.frombuffer(bytes(token_files.read(blocks, dictionary).first().ids), "<u4")[-1] == 70_000


@pytest.mark.parametrize("ids", [[None] * 900, [7] * 900, [*range(300), *[None] * 300, *[150] * 300]])
def test_ids_of_very_many_rows_are_dealt_to_several_zones(spark, monkeypatch, ids):
    monkeypatch.setattr(token_files, "ZONE_DOCS", 100)
    docs = spark.createDataFrame([(i, f"text {k % 800}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(4)
    blocks, dictionary = token_files.write(docs, WORD)
    assert blocks.select("zone").distinct().count() > 5
    rows = sorted(token_files.read(blocks, dictionary).select("doc_id", "start", "n_tokens", "ids_crc32").collect(), key=lambda r: r.start)
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in rows]
    assert order == sorted(order) and len(rows) == len(ids)


def test_a_difference_from_the_library_is_mended_and_told(spark, monkeypatch):
    texts = [(1, "some words"), (2, None), (3, "more")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    rows = sentencepieces.encode_decode(docs, PIECE).collect()
    assert not any(r.by_library for r in rows)
    batches = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: batches.append((run, self.toArrow().to_batches())))
    sentencepieces.encode_decode(docs, PIECE)
    run, given = batches[0]
    wrong = sentencepieces.PieceModel(PIECE)
    wrong.scores = {}
    monkeypatch.setattr(sentencepieces, "model", lambda path: wrong)
    told = [r for b in run(iter(given)) for r in b.to_pylist()]
    assert all(r["by_library"] for r in told) and {r["doc_id"]: r["ids_sha256"] for r in told} == {r.doc_id: r.ids_sha256 for r in rows}


def test_token_files_with_a_dictionary(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    blocks, dictionary = token_files.write(docs, WORD)
    assert dictionary
    rows = token_files.read(blocks, dictionary).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id").collect()
    e, start = encoder(WORD), 0
    for r, doc in zip(rows, docs.orderBy("doc_id").collect(), strict=True):
        ids = e.whole(doc.text) + np.array([1], "<u4").tobytes()
        assert tuple(r) == (doc.doc_id, start, len(ids) // 4, zlib.crc32(ids))
        start += r.n_tokens


def least_bins(lengths, capacity):
    """Brute force: the least number of sequences."""
    best = len(lengths)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= lengths[k]}.values():
            go(k + 1, [*rooms[:i], rooms[i] - lengths[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


def bins_of(table):
    return max((row[3] for row in table), default=-1)


def test_reduction_keeps_the_optimum():
    r = random.Random(4)
    for _ in range(150):
        capacity = r.randint(8, 20)
        lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]
        counts = {x: lengths.count(x) for x in lengths}
        fixed, rest = packing.reduce_dominated(counts, capacity)
        used = [x for items, n in fixed for _ in range(n) for x, c in items for _ in range(c)]
        left = [x for x, n in rest.items() for _ in range(n)]
        assert sorted(used + left) == sorted(lengths)
        assert all(sum(x * c for x, c in items) <= capacity for items, _ in fixed)
        assert sum(n for _, n in fixed) + least_bins(left, capacity) == least_bins(lengths, capacity)


def test_best_fit_equals_one_by_one():
    r = random.Random(5)
    for _ in range(200):
        capacity = r.randint(5, 40)
        lengths = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 60))), reverse=True)
        rooms = []
        for x in lengths:
            fit = min((room for room in rooms if room >= x), default=None)
            rooms.append(capacity - x if fit is None else fit - x)
            if fit is not None:
                rooms.remove(fit)
        patterns = packing.best_fit({x: lengths.count(x) for x in lengths}, capacity)
        assert sum(n for _, n in patterns) == len(rooms)
        assert sorted(capacity - sum(x * c for x, c in items) for items, n in patterns for _ in range(n)) == sorted(rooms)


def check_packing(rows, texts, capacity):
    e = encoder(BYTE)
    filled, docs = {}, {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, text in texts.items():
        ids = e.whole(text) + np.array([0], "<u4").tobytes()
        got = sorted(docs[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got))) and all(r.length == capacity for r in got[1:])
        for r in got:
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
        assert sum(r.length for r in got) == len(ids) // 4
    return len(filled)


def test_packing(odd, empty, spark, sf_dir):
    rows = packing.pack(odd, BYTE, capacity=16).collect()
    check_packing(rows, {i: t for i, t in enumerate(ODD_TEXTS) if i}, 16)
    assert packing.pack(empty, BYTE).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs, BYTE).collect()
    n = check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, 2048)
    assert n <= sum(r.length for r in rows) / 2048 * 1.02 + 1
