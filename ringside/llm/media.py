"""Media columns: texts or samples kept in lossless WebP images, and read back as pixel arrays.

A payload is a text's UTF-8 bytes and bytes of 0, up to a positive multiple of 64: 1 to 64 of them, so that there is always an end, or
only as many as are needed, if ``least`` is 0.  Its bytes are the samples of an image, four
to a pixel in the order red, green, blue, alpha, in rows of 16 pixels; payloads too long for 16,384 such rows take rows of 32,
64, ... pixels, so that an image holds up to 1 GiB, more than a row of a Spark table can.

A null text counts as empty and has 64 bytes of 0.  Equal texts give equal images and features; rows and other columns stay,
but for the columns that an operator adds, which replace older ones of their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame

from ringside.llm import webp
from ringside.llm.common import with_fields

UNIT = 64
ROW = 16  # pixels


def payload(text: str | None, least: int = 1) -> bytes:
    """The bytes of a text, with ``least`` bytes of 0 or more."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-(len(raw) + least) // UNIT)) * UNIT, b"\0")


def to_pixels(data: bytes) -> np.ndarray:
    width = ROW
    while len(data) + (width > ROW) > 4 * width * webp.MOST:
        width *= 2
    if width > ROW:
        data += b"\1"  # rows of more than one unit may have room left: the last byte that isn't 0 marks the payload's end
    height = -(-len(data) // (4 * width))
    pixels = np.zeros(height * width * 4, np.uint8)
    pixels[: len(data)] = np.frombuffer(data, np.uint8)
    return pixels.reshape(height, width, 4)


def from_pixels(pixels: np.ndarray) -> bytes:
    """The payload of an image."""
    data = pixels.tobytes()
    return data if pixels.shape[1] == ROW else data.rstrip(b"\0")[:-1]


def feature(pixels: np.ndarray) -> str:
    """Mean and deviation of the samples, their mean step within a row of samples, and shares of 16 bins in thousandths."""
    samples = pixels.reshape(len(pixels), -1)
    flat = samples.ravel()
    counts = np.bincount(flat, minlength=256)
    n, values = len(flat), np.arange(256)
    mean = float(counts @ values) / n
    deviation = max(0.0, float(counts @ (values * values)) / n - mean * mean) ** 0.5
    step = float(np.abs(np.diff(samples.astype(np.int16), axis=1)).sum(dtype=np.int64)) / n
    bins = (counts.reshape(16, 16).sum(axis=1) * 1000 + n // 2) // n
    return f"mean={mean:.3f};dev={deviation:.3f};step={step:.3f};bins={','.join(map(str, bins.tolist()))}"


def store(df: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """``df`` with the binary column ``out``: the payload as a lossless WebP image."""
    return with_fields(df, text_col, f"`{out}` binary", lambda: lambda texts: {out: [webp.encode(to_pixels(payload(t))) for t in texts]})


def read(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with width, height, pixels (binary, four samples a pixel) and feature of any lossless WebP images; null for null."""

    def run(media):
        images = [None if m is None else webp.decode(bytes(m)) for m in media]
        return {
            "width": [None if p is None else p.shape[1] for p in images],
            "height": [None if p is None else p.shape[0] for p in images],
            "pixels": [None if p is None else p.tobytes() for p in images],
            "feature": [None if p is None else feature(p) for p in images],
        }

    return with_fields(df, media_col, "width int, height int, pixels binary, feature string", lambda: run)


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(df: DataFrame, text_col: str = "text", least: int = 1) -> DataFrame:
    """``df`` with digests of what each text's image gives when it is read: the image needn't leave the worker."""

    def one(text):
        media = webp.encode(to_pixels(payload(text, least)))
        pixels = webp.decode(media)
        data = from_pixels(pixels)
        n = len((text or "").encode("utf-8", "surrogatepass"))
        return n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels)

    names = [c.split()[0] for c in DIGESTS.split(", ")]
    return with_fields(df, text_col, DIGESTS, lambda: lambda texts: dict(zip(names, zip(*map(one, texts), strict=True), strict=True)) if texts else {n: [] for n in names})
