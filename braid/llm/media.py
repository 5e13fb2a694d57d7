"""Media columns: payloads as 8-bit grey PNG files in binary columns, read back by chunk, and low-frequency cosine hashes of them."""
from __future__ import annotations

import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braid.llm.batches import over_texts
from braid.llm.common import documents, text_or_empty

#: Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
#: Samples in a row; payloads are padded to whole rows.
WIDTH = 576
PAD = 255
LEVEL = 6
IDAT_BYTES = 1 << 16
#: A stream holds at most so many bytes for each of its own.
RATIO = 1032
#: Samples that are unfiltered at once.
BATCH = 8 << 20


class BadMedia(ValueError):
    pass


def padded(payload: bytes, width: int = WIDTH) -> bytes:
    return payload + bytes([PAD]) * (width - len(payload) if not payload else -len(payload) % width)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def filtered(rows: np.ndarray, kind: int) -> np.ndarray:
    """Rows of samples as the filter stores them (one byte a sample)."""
    left = np.zeros_like(rows)
    left[:, 1:] = rows[:, :-1]
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    if kind == NONE:
        return rows
    if kind == SUB:
        return rows - left
    if kind == UP:
        return rows - up
    if kind == AVERAGE:
        return rows - ((left.astype(np.int16) + up) >> 1).astype(np.uint8)
    corner = np.zeros_like(rows)
    corner[1:, 1:] = rows[:-1, :-1]
    return rows - nearest(left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16)).astype(np.uint8)


def nearest(a, b, c):
    """Whichever of left, up and corner is nearest to left + up - corner; the earlier on ties."""
    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))


def chosen(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filter of each row and the rows filtered by it: the one with the least sum of absolute values, as signed bytes, and
    of those the first."""
    kinds, best, out = np.zeros(len(rows), np.uint8), None, rows
    for kind in range(5):
        now = filtered(rows, kind)
        cost = np.minimum(now, 0 - now).sum(axis=1, dtype=np.int64)
        if best is None:
            best, out = cost, now.copy()
            continue
        less = cost < best
        kinds[less], best[less], out[less] = kind, cost[less], now[less]
    return kinds, out


def write_png(payload: bytes, width: int = WIDTH, kind: int | None = None, level: int = LEVEL) -> bytes:
    """A grey PNG of the padded payload; each row has the filter that suits it best, or all have the given one."""
    rows = np.frombuffer(padded(payload, width), np.uint8).reshape(-1, width)
    raw = np.empty((len(rows), width + 1), np.uint8)
    raw[:, 0], raw[:, 1:] = chosen(rows) if kind is None else (kind, filtered(rows, kind))
    data = zlib.compress(raw.tobytes(), level)
    idat = b"".join(chunk(b"IDAT", data[i : i + IDAT_BYTES]) for i in range(0, len(data), IDAT_BYTES))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + idat + chunk(b"IEND", b"")


def unfiltered(images: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The samples of images of one width, each given as the kinds of its rows and its filtered rows.

    A sample needs those to its left, above and in the corner, so samples on a diagonal don't need each other: step t undoes
    sample t - y of row y, of all rows of all images at once. Steps are as many as the width and the rows of the tallest image.
    """
    width = images[0][1].shape[1]
    heights = np.array([len(k) for k, _ in images])
    # a row and a column of zeros before each image
    flat = np.zeros((int((heights + 1).sum()), width + 1), np.uint8)
    first = np.cumsum(heights + 1) - heights
    for at, (_, rows) in zip(first, images):
        flat[at : at + len(rows), 1:] = rows
    y = np.concatenate([np.arange(n) for n in heights])
    line = np.repeat(first, heights) + y
    order = np.argsort(y, kind="stable")  # so the rows at work in a step are a slice
    y, kinds = y[order], np.concatenate([k for k, _ in images])[order]
    base = line[order] * (width + 1) + 1 - y
    done, stride = flat.ravel(), width + 1
    edges = np.searchsorted(y, np.arange(int(heights.max()) + 1))
    average, paeth, sub, up_ = (kinds == k for k in (AVERAGE, PAETH, SUB, UP))
    for t in range(width + int(heights.max()) - 1):
        part = slice(edges[max(0, t - width + 1)], edges[min(t + 1, len(edges) - 1)])
        at = base[part] + t
        left, above, corner = (done[at - back].astype(np.int16) for back in (1, stride, stride + 1))
        guess = left * sub[part] + above * up_[part] + (left + above >> 1) * average[part] + nearest(left, above, corner) * paeth[part]
        done[at] += guess.astype(np.uint8)
    return [flat[at : at + n, 1:] for at, n in zip(first, heights)]


def parsed(media: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The kinds of the rows and the filtered rows. Raises BadMedia if a signature, length, checksum, header or stream isn't right."""
    if media[:8] != SIGNATURE:
        raise BadMedia("signature")
    at, size, data, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise BadMedia("short chunk")
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if len(body) < n or len(media) < at + 12 + n:
            raise BadMedia("short chunk")
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise BadMedia(f"checksum of {kind!r}")
        if kind == b"IHDR":
            if n != 13:
                raise BadMedia("header")
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0] or not width or not height:
                raise BadMedia("form")
            size = height, width
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise BadMedia(f"chunk {kind!r}")
        at += 12 + n
    if not ended or size is None:
        raise BadMedia("no end or header")
    height, width = size
    packed, wanted = b"".join(data), height * (width + 1)
    if wanted > (len(packed) + 1) * RATIO:  # so a header can't ask for more memory than its stream can fill
        raise BadMedia("short stream")
    try:
        raw = zlib.decompressobj().decompress(packed, wanted)
    except zlib.error as e:
        raise BadMedia(str(e)) from e
    if len(raw) != wanted:
        raise BadMedia("short stream")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    if (rows[:, 0] > PAETH).any():
        raise BadMedia(f"filter {rows[:, 0].max()}")
    return rows[:, 0], rows[:, 1:]


def read_png(media: bytes) -> np.ndarray:
    """The samples of one file, as a matrix."""
    return unfiltered([parsed(media)])[0]


def read_pngs(files: list[bytes]) -> list[np.ndarray | BadMedia]:
    """The samples of each file or what is wrong with it. Files of one width are unfiltered together, up to BATCH samples at once."""
    out: list = []
    groups: dict[int, list[int]] = {}
    for i, media in enumerate(files):
        try:
            out.append(parsed(media))
            groups.setdefault(out[i][1].shape[1], []).append(i)
        except BadMedia as e:
            out.append(e)
    for members in groups.values():
        while members:
            take, total = 1, out[members[0]][1].size
            while take < len(members) and (total := total + out[members[take]][1].size) <= BATCH:
                take += 1
            for i, samples in zip(members, unfiltered([out[i] for i in members[:take]])):
                out[i] = samples
            members = members[take:]
    return out


@cache
def cosines(n: int) -> np.ndarray:
    """The orthonormal cosine transform of length n."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    out = np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.sqrt(2 / n)
    out[0] /= np.sqrt(2)
    return out


def shrunk(rows: np.ndarray, n: int, axis: int) -> np.ndarray:
    """n bands of means along an axis; a shorter axis repeats its rows."""
    size = rows.shape[axis]
    if size < n:
        return np.take(rows, np.arange(n) * size // n, axis=axis).astype(np.float64)
    edges = np.arange(n) * size // n
    shape = (-1, 1) if axis == 0 else (1, -1)
    return np.add.reduceat(rows, edges, axis=axis, dtype=np.float64) / np.diff([*edges, size]).reshape(shape)


def cosine_hash(samples: np.ndarray, side: int = 32, low: int = 8) -> bytes:
    """low * low bits: which low-frequency coefficients of the image shrunk to side * side exceed their median (the mean's aside)."""
    image = shrunk(shrunk(samples, side, 0), side, 1)
    c = cosines(side)[:low]
    coefficients = np.round(c @ image @ c.T, 6).ravel()
    return np.packbits(coefficients > np.median(coefficients[1:])).tobytes()


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id_col, n_bytes, media): each text's UTF-8 bytes as a PNG. Null texts are empty; an empty payload is one row of padding.

    A text of any length is one file. Each row is stored by itself, so repeated and null ids stay; equal texts give equal files.
    An empty table gives an empty result. Other columns are ignored. Nothing is shuffled.
    """

    def make():
        def f(batch):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_png(t, width) for t in texts], pa.binary())], names)

        return f

    names = [id_col, "n_bytes", "media"]
    rows = df.select(F.col(id_col), text_or_empty(text_col).alias("__text"))
    return over_texts(rows, "__text", make, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_bytes long, media binary")


def read_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", carry=()) -> DataFrame:
    """(id_col, carry..., media, payload, feature, error): what each PNG holds and its cosine hash. Bad, empty and null media give
    an error and nulls. One row per input row, repeated and null ids included; an empty table gives an empty result."""

    def make():
        def f(batch):
            payloads, hashes, errors = [], [], []
            for samples in read_pngs([m or b"" for m in batch.column(batch.num_columns - 1).to_pylist()]):
                bad = isinstance(samples, BadMedia)
                payloads.append(None if bad else samples.tobytes())
                hashes.append(None if bad else cosine_hash(samples))
                errors.append(str(samples) if bad else None)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(hashes, pa.binary()), pa.array(errors, pa.string())], [*batch.schema.names, "payload", "feature", "error"])

        return f

    rows = df.select(id_col, *carry, F.col(media_col).alias("media"))
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema)
    return over_texts(rows, "media", make, f"{schema}, payload binary, feature binary, error string")


def op9_media(spark, sf_dir: str) -> DataFrame:
    stored = store_media(documents(spark, sf_dir))
    read = read_media(stored, carry=["n_bytes"])
    size = F.octet_length("payload")
    return read.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), F.greatest(size - 31, F.lit(1)), F.lit(32))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("feature")).alias("feature"),
    )
