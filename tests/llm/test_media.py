"""Media columns: exact round trips, damaged files, and the hash against its definition."""
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from braid.llm import media


@pytest.mark.parametrize("kind", range(5))
def test_round_trip(kind):
    r = random.Random(kind)
    for n in (0, 1, 575, 576, 577, 576 * 40 + 3):
        payload = bytes(r.randrange(256) for _ in range(n))
        stored = media.write_png(payload, kind=kind)
        assert media.read_png(stored).tobytes() == media.padded(payload)
        assert len(media.padded(payload)) % 576 == 0 and len(media.padded(payload)) >= 576


def plainly(kinds, rows):
    """The format's definition, sample by sample."""
    out = [[0] * rows.shape[1] for _ in rows]
    for y, row in enumerate(rows.tolist()):
        for x, value in enumerate(row):
            a = out[y][x - 1] if x else 0
            b = out[y - 1][x] if y else 0
            c = out[y - 1][x - 1] if x and y else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[y][x] = (value + (0, a, b, (a + b) // 2, paeth)[kinds[y]]) % 256
    return np.array(out, np.uint8)


def test_unfiltering_against_the_definition():
    r = np.random.default_rng(1)
    images = [(r.integers(0, 5, n).astype(np.uint8), r.integers(0, 256, (n, 37), dtype=np.uint8)) for n in (1, 2, 50, 90)]
    for (kinds, rows), got in zip(images, media.unfiltered(images)):
        assert (got == plainly(kinds, rows)).all()


def test_filters_are_chosen_by_row():
    r = np.random.default_rng(3)
    ramp = np.add.outer(np.arange(40) * 3, np.arange(576)).astype(np.uint8)
    rows = np.concatenate([ramp, np.repeat(r.integers(0, 256, (1, 576), dtype=np.uint8), 5, axis=0), r.integers(0, 20, (5, 576), dtype=np.uint8)])
    kinds, stored = media.chosen(rows)
    assert len(set(kinds.tolist())) >= 3
    for y, kind in enumerate(kinds):
        cost = [int(np.abs(media.filtered(rows, k)[y].view(np.int8).astype(int)).sum()) for k in range(5)]
        assert cost[kind] == min(cost) and (stored[y] == media.filtered(rows, kind)[y]).all()
    assert (media.read_png(media.write_png(rows.tobytes())) == rows).all()


def test_several_files_at_once():
    files = [media.write_png(bytes(range(256)) * n, width=w) for n, w in ((1, 7), (30, 576), (3, 7), (9, 576))]
    got = media.read_pngs([files[0], b"no", *files[1:]])
    assert isinstance(got[1], media.BadMedia)
    assert [g.tobytes() for g in got[:1] + got[2:]] == [media.read_png(f).tobytes() for f in files]


def test_damage():
    stored = media.write_png(b"hello " * 500)
    for at in range(0, len(stored), 7):
        bad = bytearray(stored)
        bad[at] ^= 1
        with pytest.raises(media.BadMedia):
            media.read_png(bytes(bad))
    for cut in (0, 8, 20, len(stored) - 1):
        with pytest.raises(media.BadMedia):
            media.read_png(stored[:cut])
    for size in (0, 12, 14):
        with pytest.raises(media.BadMedia):
            media.read_png(media.SIGNATURE + media.chunk(b"IHDR", bytes(size)) + media.chunk(b"IEND", b""))


def test_hash_is_of_low_frequencies():
    wave = np.add.outer(np.cos(np.arange(64) / 9), np.cos(np.arange(576) / 70)) * 100 + 128
    noisy = wave + np.random.default_rng(2).normal(0, 5, wave.shape)
    a, b = (int.from_bytes(media.cosine_hash(x.astype(np.uint8))) for x in (wave, noisy))
    assert bin(a ^ b).count("1") <= 8
    assert media.cosine_hash(wave.astype(np.uint8)) == media.cosine_hash(wave.astype(np.uint8).copy())


def plain_hash(payload: bytes) -> str:
    """The cosine hash by its definition: means of 32 x 32 areas, the transform's sums, bits over the median of all but the first."""
    h = len(payload) // 576
    rows = [payload[576 * i : 576 * i + 576] for i in range(h)]
    y_of = [range(i * h // 32, (i + 1) * h // 32) if h >= 32 else [i * h // 32] for i in range(32)]
    image = [[sum(rows[y][x] for y in ys for x in range(18 * j, 18 * j + 18)) / (18 * len(ys)) for j in range(32)] for ys in y_of]

    def wave(k, x):
        return math.sqrt((1 if k == 0 else 2) / 32) * math.cos(math.pi * k * (2 * x + 1) / 64)

    c = [round(sum(wave(u, y) * wave(v, x) * image[y][x] for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(c[1:])[31]
    return f"{int(''.join('1' if x > middle else '0' for x in c), 2):016x}"


def test_query(spark, tmp_path):
    rows = [(1, "ab" * 400, "x"), (2, None, "y"), (3, "", None), (4, "ab" * 400, "z"), (None, "ñ" * 100_000, "n")]
    spark.createDataFrame(rows, "doc_id long, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in media.op9_media(spark, str(tmp_path)).collect()}
    assert len(got) == 5
    for i, t, _ in rows:
        payload = media.padded((t or "").encode())
        assert (got[i].n_bytes, got[i].payload_bytes) == (len((t or "").encode()), len(payload))
        assert got[i].tail_crc32 == zlib.crc32(payload[-32:])
        stored = media.write_png((t or "").encode())
        assert (got[i].media_bytes, got[i].media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert got[i].feature == plain_hash(payload)
    assert got[1][1:] == got[4][1:] and got[2][1:] == got[3][1:]
    empty = spark.createDataFrame([], "doc_id long, text string, media string, payload string")
    assert media.read_media(media.store_media(empty)).collect() == []
    bad = spark.createDataFrame([(1, b"no"), (2, None)], "doc_id long, media binary")
    assert [r.error for r in media.read_media(bad).collect()] == ["signature", "signature"]
