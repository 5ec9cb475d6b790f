"""Sinks: page records, completion rows, PNG images, archives."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_records(pages: DataFrame, path: str, *, append: bool = False) -> None:
    """Line-delimited page records; the image, if there is one, is left out. Nulls are written, since a missing ratio has another meaning."""
    pages.drop("image").write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def mark_done(pages: DataFrame, path: str, number: int) -> None:
    """Appends the pages (column page) to the completion table; the job's commit makes it all or nothing."""
    pages.select("page", F.lit(number).alias("pass"), F.current_timestamp().alias("ts")).write.mode("append").parquet(path)


def png(image: np.ndarray) -> bytes:
    """A BGR or grey image as PNG."""
    rows = image[..., ::-1] if image.ndim == 3 else image
    h, w = image.shape[:2]
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rows).reshape(h, -1)], 1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def write_images(pages: DataFrame, folder: str) -> DataFrame:
    """Writes each page (page, image) as a PNG below the URI; returns page and path (lazy).

    A file is written under its own name in one step, so a task that runs twice leaves the same file.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        from ..operators.pixels import decoded

        for frame in frames:
            system, base = fs.FileSystem.from_uri(folder)
            system.create_dir(base)
            rows = []
            for page, image in zip(frame["page"], frame["image"], strict=True):
                name = f"{page.rpartition('.')[0] or page}.png"
                with system.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(png(decoded(image)))
                rows.append((page, f"{folder}/{name}"))
            yield pd.DataFrame(rows, columns=["page", "path"])

    return pages.select("page", "image").mapInPandas(run, "page string, path string")


def archive(files: Iterable[tuple[str, bytes]]) -> bytes:
    """A ZIP of (name, content), for one user's download; not for tables."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files:
            z.writestr(name, content)
    return out.getvalue()
