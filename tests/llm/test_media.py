import hashlib
import random
import zlib

import numpy as np
import pytest

from trustmill.llm import media

from .conftest import ODD_TEXTS


@pytest.mark.parametrize("kind", range(5))
def test_all_filters_round_trip(kind):
    data = random.Random(kind).randbytes(192 * 7)
    png = media.write_png(data, kind=kind)
    assert media.read_png(png).tobytes() == data


def test_mixed_filters():
    rows = np.frombuffer(random.Random(9).randbytes(24 * 10), np.uint8).reshape(10, 24)
    kinds = [0, 2, 2, 1, 4, 4, 3, 2, 0, 3]
    every = [media.filtered(rows, k) for k in range(5)]
    mixed = np.stack([every[k][y] for y, k in enumerate(kinds)])
    assert (media.unfiltered(mixed.tobytes(), 10, 24) == rows).all()


def test_rows_written_by_the_operator_use_filters(spark):
    r = random.Random(5)
    line = "".join(r.choice("abcdefgh") for _ in range(192))
    text = line * 3 + "x" * 192 + "\x00" * 192
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    png = bytes(media.write(docs).first().media)
    at = png.index(b"IDAT")
    data = zlib.decompress(png[at + 4 : at + 4 + int.from_bytes(png[at - 4 : at], "big")])
    assert set(data[:: media.WIDTH + 1]) == {0, 1, 2} and media.read_png(png).tobytes() == text.encode()


def test_damage_is_found():
    png = bytearray(media.write_png(b"a" * 384))
    for at in (3, 20, 45, len(png) - 1):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.read_png(bytes(bad))
    with pytest.raises(ValueError):
        media.read_png(bytes(png[:-12]))


def test_hash_follows_brute_force():
    x = np.frombuffer(random.Random(1).randbytes(192 * 5), np.uint8).reshape(5, 192)
    slow = [[sum(float(x[y, c]) * np.cos(np.pi / 5 * u * (y + 0.5)) * np.cos(np.pi / 192 * v * (c + 0.5)) for y in range(5) for c in range(192)) for v in range(8)] for u in range(8)]
    flat = np.round(np.array(slow).ravel() / x.size, 4)
    assert media.cosine_hash(x) == np.packbits(flat > np.median(flat[1:])).tobytes().hex()


def test_rows(odd, empty):
    images = {r.doc_id: bytes(r.media) for r in media.write(odd).collect()}
    rows = media.media(odd).collect()
    assert len(rows) == odd.count() and media.media(empty).count() == 0
    by = {r.doc_id: r for r in rows if r.doc_id not in (0, None)}
    for i, text in list(enumerate(ODD_TEXTS))[1:]:
        data = (text or "").encode()
        payload = data.ljust(max(192, -(-len(data) // 192) * 192))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes == len(images[i]) and r.media_sha256 == hashlib.sha256(images[i]).hexdigest()
        assert media.read_png(images[i]).tobytes() == payload
    assert by[10].feature == by[11].feature and by[10].media_sha256 == by[11].media_sha256


def test_a_text_of_some_megabytes_in_bounded_memory():
    import tracemalloc

    r = random.Random(2)
    text = "".join(r.choice("abcdef gh\n") for _ in range(3_000_000)) + "日本" * 300_000
    payload, n = media.payload_of(text)
    tracemalloc.start()
    png = media.write_png(payload, kind=None)
    assert tracemalloc.get_traced_memory()[1] < 4 * len(payload)
    tracemalloc.stop()
    samples = media.read_png(png)
    assert n == len(text.encode()) and samples.tobytes() == payload and len(media.cosine_hash(samples)) == 16
    rows = np.frombuffer(payload, np.uint8).reshape(-1, media.WIDTH)
    # filters are chosen as they were before rows were taken in parts
    signed = [np.abs(media.filtered(rows, k)[:, 1:].view(np.int8).astype(np.int32)).sum(axis=1) for k in range(3)]
    data = zlib.decompress(png[png.index(b"IDAT") + 4 : -16])
    assert (np.frombuffer(data, np.uint8).reshape(-1, media.WIDTH + 1)[:, 0] == np.argmin(signed, axis=0)).all()
