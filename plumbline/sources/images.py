"""Images of visual questions, decoded in the workers that hand them to a model.

PNG is read here, with nothing but zlib and numpy; other formats need the imaging library that a model
brings along.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from plumbline.sources.tables import ship

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type: grey, RGB, palette, grey and alpha, RGBA.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 12 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != int.from_bytes(raw[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("a damaged chunk")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise ValueError("no end")


def _unfiltered(data: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Scan lines without their filters: each byte adds what was left of it (``step`` bytes), above it, or both."""
    if len(data) != height * (stride + 1):
        raise ValueError("too few or too many bytes")
    lines = np.frombuffer(data, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride + step), np.uint8)  # a row and a pixel of zeros before the first
    for y in range(height):
        kind, line, above, row = lines[y, 0], lines[y, 1:], out[y], out[y + 1]
        if kind in (0, 2):
            row[step:] = line if kind == 0 else line + above[step:]
        elif kind == 1:
            for k in range(step):
                row[step + k :: step] = np.cumsum(line[k::step], dtype=np.uint64).astype(np.uint8)
        elif kind == 3:
            for x in range(stride):
                row[step + x] = (int(line[x]) + (int(row[x]) + int(above[step + x])) // 2) & 255
        elif kind == 4:
            for x in range(stride):
                a, b, c = int(row[x]), int(above[step + x]), int(above[x])
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[step + x] = (int(line[x]) + near) & 255
        else:
            raise ValueError("an unknown filter")
    return out[1:, step:]


def png(raw: bytes) -> np.ndarray:
    """Height x width x 3 bytes of a PNG file, without its transparency; ValueError where it is none, is damaged, or is
    of a kind that isn't read here (interlaced, or fewer than 8 bits a sample)."""
    if not raw.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    head, palette, data = None, None, []
    for kind, body in _chunks(raw):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    if head is None or head[3] not in SAMPLES or head[2] not in (8, 16) or head[6] or 0 in head[:2]:
        raise ValueError("a kind of PNG that isn't read")
    width, height, bits, colour = head[:4]
    size = bits // 8
    try:
        lines = _unfiltered(zlib.decompress(b"".join(data)), height, width * SAMPLES[colour] * size, SAMPLES[colour] * size)
    except zlib.error as e:
        raise ValueError("damaged data") from e
    pixels = lines.reshape(height, width, SAMPLES[colour], size)[..., 0]  # the high byte of 16 bits
    if colour == 3:
        if palette is None or pixels.max() >= len(palette):
            raise ValueError("no such colour")
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, axis=2) if colour in (0, 4) else np.ascontiguousarray(pixels[..., :3])


def pixels(raw: bytes | None) -> np.ndarray | None:
    """The RGB pixels of an image file; None for null.  ValueError where it can't be read."""
    if raw is None:
        return None
    if raw.startswith(SIGNATURE):
        return png(raw)
    import io

    try:
        from PIL import Image  # only for other formats
    except ModuleNotFoundError as e:
        raise ValueError("not a PNG file, and no imaging library") from e
    try:
        return np.asarray(Image.open(io.BytesIO(raw)).convert("RGB"))
    except Exception as e:  # whatever the library raises on files that are none
        raise ValueError("not an image") from e


def described(df: DataFrame, column: str = "image_1") -> DataFrame:
    """df with ``image``, struct<width, height, mean, fault>: what the workers make of ``column`` (bytes, or a struct with
    bytes).  Null bytes give null; for bytes that can't be read only ``fault`` is set.  Pixels stay in the workers."""
    ship(df.sparkSession)

    def run(frames):
        for f in frames:
            out = []
            for cell in f[column]:
                raw = cell.get("bytes") if isinstance(cell, dict) else cell
                try:
                    p = pixels(None if raw is None else bytes(raw))
                    out.append(None if p is None else {"width": p.shape[1], "height": p.shape[0], "mean": float(p.mean()), "fault": None})
                except ValueError as e:
                    out.append({"width": None, "height": None, "mean": None, "fault": str(e)})
            yield f.assign(image=pd.Series(out, index=f.index, dtype=object))

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields if x.name != "image")
    return df.drop("image").mapInPandas(run, f"{fields}, image struct<width:int,height:int,mean:double,fault:string>")
