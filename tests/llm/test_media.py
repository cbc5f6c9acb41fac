import hashlib
import io
import struct
import zlib

import numpy as np

from quillgraph.llm.media import _shrink, area_resize, decode, difference_hash, encode_bmp, encode_ppm, media_features, npy_tile, text_media

RNG = np.random.default_rng(4)


def plain_resize(image, height, width):
    """Area means, cell by cell."""
    out = np.zeros((height, width, *image.shape[2:]))
    spans = lambda n, to: [[(i, max(0.0, min(i + 1, (k + 1) * n / to) - max(i, k * n / to))) for i in range(n)] for k in range(to)]
    for y, ys in enumerate(spans(image.shape[0], height)):
        for x, xs in enumerate(spans(image.shape[1], width)):
            out[y, x] = sum(a * b * image[i, j].astype(float) for i, a in ys for j, b in xs) / sum(a * b for _, a in ys for _, b in xs)
    return out


def test_resize_equals_cell_means():
    for shape, to in (((5, 7, 3), (3, 4)), ((8, 9), (8, 9)), ((2, 3), (5, 7)), ((1, 1, 3), (4, 4)), ((13, 64, 3), (8, 9))):
        image = RNG.integers(0, 256, shape, np.uint8)
        np.testing.assert_allclose(area_resize(image, *to), plain_resize(image, *to), atol=1e-9)
    tall = RNG.integers(0, 256, (20_001, 2), np.uint8)
    np.testing.assert_allclose(_shrink(tall, 3).mean(), tall.mean(), atol=1e-6)


def test_round_trips():
    for shape in ((1, 1, 3), (5, 7, 3), (3, 64, 3)):
        image = RNG.integers(0, 256, shape, np.uint8)
        assert np.array_equal(decode(encode_ppm(image)), image) and np.array_equal(decode(encode_bmp(image)), image)
    grey = RNG.integers(0, 256, (4, 6), np.uint8)
    assert np.array_equal(decode(encode_ppm(grey)), grey)
    assert np.load(io.BytesIO(npy_tile(grey, 32))).shape == (32, 32)


def test_other_kinds():
    assert decode(b"P1\n# c\n3 2\n1 0 1\n010").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert decode(b"P4 3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert decode(b"P2 2 1 255\n7 9").tolist() == [[7, 9]]
    assert decode(b"P3 1 1 #x\n255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert decode(b"P5 1 2 65535\n\x01\x00\x00\x02").tolist() == [[256], [2]]
    assert [decode(x) for x in (b"", b"P7 1 1", b"P6 2 2 255\n\x00", b"BM", b"BM" + bytes(60), b"P6 0 0 255\n")] == [None] * 6


def test_hash_sees_gradients():
    falling = np.tile(np.arange(255, 0, -4, dtype=np.uint8), (20, 1))
    assert difference_hash(npy_tile(falling, 32)) == "f" * 16 and difference_hash(npy_tile(falling[:, ::-1], 32)) == "0" * 16


def test_texts_as_media(spark):
    texts = [None, "", "é" * 96, "x" * 193, "long text " * 200_000, "same", "same"]
    rows = spark.createDataFrame([(i, t, b"", "clash") for i, t in enumerate(texts)], "doc_id long, text string, media binary, feature string")
    got = {r.doc_id: r for r in media_features(text_media(rows), ["doc_id", "n_bytes"]).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = encode_ppm(np.frombuffer(payload, np.uint8).reshape(-1, 64, 3))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert got[5][1:] == got[6][1:] and media_features(text_media(rows.limit(0)), ["doc_id"]).count() == 0


def test_what_is_no_image(spark):
    rows = spark.createDataFrame([(None, None), (1, b"junk")], "id long, media binary")
    got = {r.id: r for r in media_features(rows, ["id"]).collect()}
    assert not got[None].decoded and got[None].media_bytes is None and got[1].media_bytes == 4 and got[1].feature is None


def test_no_bytes_raise():
    """Headers that lie, samples over the maximum, short palettes, cut and changed images."""
    bad = [b"P5\n99999999999 99999999999\n255\n", b"P2 1 1 255\n99999999999999999999", b"P2 1 1 255\n999", b"P2 1 1 255\n-1", b"P2 1 1 255\n1_0", b"P1 2 2 01", b"P5 1 1 9\n\x0a", b"P6 " + b"9" * 5000 + b" 1 255\n"]
    bad.append(struct_bmp(colours=2, index=7))
    bad.append(struct_bmp(colours=2**31, index=0))
    assert [decode(x) for x in bad] == [None] * len(bad)
    assert decode(struct_bmp(colours=2, index=1)).tolist() == [[[6, 5, 4]]]
    rng = np.random.default_rng(8)
    image = rng.integers(0, 256, (3, 5, 3), np.uint8)
    seeds = [encode_ppm(image), encode_bmp(image), struct_bmp(2, 1), b"P1 3 2\n1 0 1\n010", b"P4 3 2\n\xa0\x40", b"P2 2 1 255\n7 9", b"P3 1 1 255\n255 1 2", b"P5 1 2 65535\n\x01\x00\x00\x02"]
    for _ in range(20_000):
        x = bytearray(seeds[rng.integers(len(seeds))])
        for _ in range(rng.integers(1, 5)):
            x[rng.integers(len(x))] = rng.integers(256)
        got = decode(bytes(x[: rng.integers(1, len(x) + 1)] if rng.random() < 0.3 else x))
        assert got is None or npy_tile(got, 4)


def struct_bmp(colours, index):
    palette = bytes([1, 2, 3, 0, 4, 5, 6, 0])
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 66, 0, 0, 62, 40, 1, 1, 1, 8, 0, 4, 0, 0, colours, 0) + palette + bytes([index, 0, 0, 0])


def test_wide_and_tall_images_are_alike():
    image = RNG.integers(0, 256, (3000, 7, 3), np.uint8)
    np.testing.assert_allclose(area_resize(image, 6, 5), np.swapaxes(area_resize(np.swapaxes(image, 0, 1), 5, 6), 0, 1), atol=1e-9)
    np.testing.assert_allclose(area_resize(image, 6, 5), plain_resize(image, 6, 5), atol=1e-8)


def test_query_stores_texts_in_both_kinds(spark):
    from quillgraph.llm.queries import op4_media

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op4_media(spark, sf).collect()}
    kinds = set()
    for i, t in texts.items():
        raw = t.encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
        stored = (encode_bmp if zlib.crc32(payload) % 2 else encode_ppm)(image)
        kinds.add(stored[:2])
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.media_bytes, r.media_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), len(stored), hashlib.sha256(stored).hexdigest())
        assert np.array_equal(np.load(io.BytesIO(r.tile)), np.rint(plain_resize(image, 16, 16)).astype(np.uint8)) if len(raw) < 2000 else len(r.tile) == 128 + 768
        assert r.feature == difference_hash(bytes(r.tile))
    assert kinds == {b"BM", b"P6"} and got.keys() == texts.keys()
