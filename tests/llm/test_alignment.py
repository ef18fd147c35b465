import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from trustmill.llm import alignment

from .conftest import ODD_TEXTS, words

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(BYTE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PIECE)
FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def spans(ids, bytes_of):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(bytes_of(i))))
        at = out[-1][2]
    return out


def a_bytes(i):
    from trustmill.llm.tokens import SIGNS

    back = {s: b for b, s in SIGNS.items()}
    return bytes(back[c] for c in A.id_to_token(i))


def b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def brute(texts):
    """Every pair of tokens compared; counts over all documents."""
    docs = []
    for text in texts:
        a = spans(A.encode(" " + text, add_special_tokens=False).ids, a_bytes) if text else []
        b = spans(B.encode(text), b_bytes) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes(x[0]) for x in a) != whole or b"".join(b_bytes(x[0]) for x in b) != whole:
            docs.append(None)
            continue
        links = Counter((i, k) for i, lo, hi in a for k, lo2, hi2 in b if lo < hi2 and lo2 < hi)
        common = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, lo = [], 0
        for hi in common:
            groups.append(",".join(str(x[0]) for x in a if lo < x[2] <= hi) + "|" + ",".join(str(x[0]) for x in b if lo < x[2] <= hi))
            lo = hi
        docs.append((len(a), len(b), groups, links))
    counts = Counter(pair for d in docs if d for pair in d[3])
    top = defaultdict(int)
    for (i, _), n in counts.items():
        top[i] = max(top[i], n)
    out = []
    for d in docs:
        if not d:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        best = sum(n for pair, n in d[3].items() if counts[pair] == top[pair[0]])
        out.append((d[0], d[1], len(d[2]), sum(d[3].values()), best, sum(n * counts[pair] for pair, n in d[3].items()), hashlib.sha256(";".join(d[2]).encode()).hexdigest()))
    return out


EXTRA = ["a ▁b", "▁", "two  spaces", " lead", "trail ", "a \n b", "naïve 日本 😀 x" * 3, "\x00 \x1c y", words(1, 300), words(2, 300), words(1, 300)]


def test_rows_against_brute_force(spark, odd, empty):
    texts = [r.text for r in odd.orderBy("doc_id", "text").collect()]
    docs = odd.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(EXTRA)], "doc_id long, text string"), allowMissingColumns=True)
    got = Counter(tuple(r[x] for x in FIELDS) for r in alignment.align(docs, BYTE, PIECE).collect())
    assert got == Counter(brute(texts + EXTRA))
    assert alignment.align(empty, BYTE, PIECE).collect() == []


@pytest.mark.parametrize("small", [False, True])
def test_documents_against_brute_force(spark, sf_dir, monkeypatch, small):
    if small:  # rows of one posting, sums after every batch; ids of A dealt to many tasks
        for name, n in (("POSTINGS", 1), ("HELD", 1), ("ROW", 0)):
            monkeypatch.setattr(alignment, name, n)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 1500").limit(60).select("doc_id", "text").cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, brute(texts.values())))
    rows = alignment.align(docs.repartition(4), BYTE, PIECE).collect()
    assert {r.doc_id: tuple(r[x] for x in FIELDS) for r in rows} == want and len(rows) == len(texts)


def test_pieces_equal_whole_texts():
    m = alignment.aligner(BYTE, PIECE)
    for text in [x for x in ODD_TEXTS + EXTRA if x and "▁" not in x]:
        pieces, whole = m.align(text), m.piece(text)
        assert tuple(sum(x[k] for x in pieces) for k in range(3)) == whole[:3] and ";".join(x[4] for x in pieces) == whole[4]
