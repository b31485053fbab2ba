"""Point clouds in PLY files: writing, inspection and a lossless archive of their fields."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Scalar types of the format and their numpy names.
TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8"}
MAGIC = b"QPLY"


def inspect(data: bytes) -> list[tuple[str, int, int, int]]:
    """(element, count, bytes of a row, start) of each element of a binary little-endian file with scalar properties only."""
    end = data.find(b"end_header\n")
    if not data.startswith(b"ply\n") or end < 0 or b"format binary_little_endian 1.0" not in data[:end]:
        raise ValueError("no binary little-endian PLY file")
    found: list[list] = []
    for line in data[:end].decode("ascii").split("\n"):
        if m := re.fullmatch(r"element (\w+) (\d+)", line):
            found.append([m[1], int(m[2]), 0])
        elif line.startswith("property"):
            m = re.fullmatch(r"property (\w+) (\w+)", line)
            if not m or m[1] not in TYPES or not found:
                raise ValueError(f"a property that isn't a scalar: {line}")
            found[-1][2] += np.dtype(TYPES[m[1]]).itemsize
    at, out = end + len(b"end_header\n"), []
    for name, count, stride in found:
        out.append((name, count, stride, at))
        at += count * stride
    if at != len(data):
        raise ValueError("a PLY body doesn't match its header")
    return out


def write(points: np.ndarray) -> bytes:
    """An n x 3 array of single-precision points as a file."""
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(points)}\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    return head.encode() + points.astype("<f4").tobytes()


def archive(data: bytes) -> bytes:
    """A packet with the rows of each element turned into planes of equal bytes, which compress better."""
    elements = inspect(data)
    start = elements[0][3] if elements else len(data)
    planes = b"".join(np.frombuffer(data[at : at + n * w], np.uint8).reshape(n, w).T.tobytes() for _, n, w, at in elements if w)
    body = zlib.compress(data[:start] + planes, 9)
    return MAGIC + hashlib.sha256(data).digest() + struct.pack("<I", start) + body


def restore(packet: bytes) -> bytes:
    if packet[:4] != MAGIC:
        raise ValueError("no archive")
    start, flat = struct.unpack("<I", packet[36:40])[0], zlib.decompress(packet[40:])
    head, at, parts = flat[:start], start, []
    rows = [(int(m[1]), m.start()) for m in re.finditer(rb"element \w+ (\d+)", head)]
    widths = [sum(np.dtype(TYPES[p.decode()]).itemsize for p in re.findall(rb"property (\w+) \w+", head[a:b])) for (_, a), b in zip(rows, [*[r[1] for r in rows[1:]], len(head)], strict=True)]
    for (n, _), w in zip(rows, widths, strict=True):
        parts.append(np.frombuffer(flat[at : at + n * w], np.uint8).reshape(w, n).T.tobytes())
        at += n * w
    data = head + b"".join(parts)
    if hashlib.sha256(data).digest() != packet[4:36]:
        raise ValueError("an archive's bytes don't match its digest")
    return data


def clouds(points: DataFrame) -> DataFrame:
    """(cloud, content) of points (cloud, place, x, y, z), one file a cloud."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cloud": [key[0]], "content": [write(rows.sort_values("place")[["x", "y", "z"]].to_numpy())]})

    return points.groupBy("cloud").applyInPandas(one, "cloud long, content binary")


def reports(files: DataFrame) -> DataFrame:
    """(cloud, element, points, stride, bytes, restored): what a file holds, and whether its archive gives it back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, content in zip(batch["cloud"], batch["content"], strict=True):
                content = bytes(content)
                same = restore(archive(content)) == content
                out += [(key, name, n, w, len(content), same) for name, n, w, _ in inspect(content)]
            yield pd.DataFrame(out, columns=["cloud", "element", "points", "stride", "bytes", "restored"])

    return files.select("cloud", "content").mapInPandas(run, "cloud long, element string, points long, stride int, bytes long, restored boolean")
