"""Image and record files: Netpbm and PNG coding, header inspection, exemplar memories and ledgers."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Bytes of a file that its header is looked for in, and of a ledger record at most.
HEAD, RECORD = 65_536, 16_384


def encode_ppm(image: np.ndarray, magic: str = "P6") -> bytes:
    """An h x w x 3 array of bytes as a Netpbm file, binary (P6) or plain (P3)."""
    h, w = image.shape[:2]
    head = f"{magic}\n{w} {h}\n255\n".encode()
    if magic == "P6":
        return head + image.astype(np.uint8).tobytes()
    return head + "\n".join(" ".join(map(str, row)) for row in image.reshape(h, -1).tolist()).encode() + b"\n"


def decode_ppm(data: bytes) -> np.ndarray:
    """The pixels of a P3 or P6 file; comments may stand in its header."""
    fields, at = [], 0
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("a Netpbm header ends early")
        fields.append(data[at:end])
        at = end
    magic, w, h, top = fields[0], *map(int, fields[1:])
    if magic not in (b"P3", b"P6") or not 0 < top < 256:
        raise ValueError("only P3 and P6 files of one byte a channel are read")
    body = data[at + 1 :]
    flat = np.frombuffer(body, dtype=np.uint8)[: w * h * 3] if magic == b"P6" else np.array(body.split(), dtype=np.int64)
    if len(flat) != w * h * 3 or (len(flat) and flat.max() > top):
        raise ValueError("a Netpbm body doesn't match its header")
    return flat.reshape(h, w, 3).astype(np.int64)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(image: np.ndarray) -> bytes:
    """An h x w x 3 array as a PNG file: one data chunk, no filter; equal images give equal bytes."""
    h, w = image.shape[:2]
    rows = b"".join(b"\0" + r.tobytes() for r in image.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows, 9)) + _chunk(b"IEND", b"")


def inspect_png(data: bytes) -> tuple[list[str], dict[bytes, bytes]]:
    """(violations, chunks) of a PNG file: signature, chunk lengths, checksums and order."""
    wrong, chunks, at = [], {}, 8
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return ["signature"], {}
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or len(data) < at + 12 + size:
            wrong.append("truncated")
            break
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            wrong.append(f"checksum:{kind.decode('latin-1')}")
        chunks[kind] = chunks.get(kind, b"") + body
        at += 12 + size
    wrong += [f"missing:{k.decode()}" for k in (b"IHDR", b"IDAT", b"IEND") if k not in chunks]
    return wrong, chunks


def decode_png(data: bytes) -> np.ndarray:
    """The pixels of a file that ``encode_png`` has written; others are refused."""
    wrong, chunks = inspect_png(data)
    if wrong:
        raise ValueError(", ".join(wrong))
    w, h, depth, kind, *_ = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    rows = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), dtype=np.uint8)
    if (depth, kind) != (8, 2) or len(rows) != h * (1 + 3 * w) or rows.reshape(h, -1)[:, 0].any():
        raise ValueError("only 8-bit colour without filters is read")
    return rows.reshape(h, -1)[:, 1:].reshape(h, w, 3).astype(np.int64)


def encode_images(px: DataFrame, form: str = "png") -> DataFrame:
    """(image_id, content): each image of a pixel table as the bytes of a file."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((rows["y"].max() + 1, rows["x"].max() + 1, 3), dtype=np.uint8)
        image[rows["y"], rows["x"]] = rows[["r", "g", "b"]].to_numpy()
        return pd.DataFrame({"image_id": [key[0]], "content": [encode_png(image) if form == "png" else encode_ppm(image)]})

    return px.groupBy("image_id").applyInPandas(one, "image_id long, content binary")


def decode_images(files: DataFrame, form: str = "png") -> DataFrame:
    """The pixel table of files (image_id, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, content in zip(batch["image_id"], batch["content"], strict=True):
                image = (decode_png if form == "png" else decode_ppm)(bytes(content))
                y, x = np.indices(image.shape[:2])
                yield pd.DataFrame({"image_id": key, "y": y.ravel(), "x": x.ravel(), "r": image[..., 0].ravel(), "g": image[..., 1].ravel(), "b": image[..., 2].ravel()})

    return files.select("image_id", "content").mapInPandas(run, "image_id long, y int, x int, r int, g int, b int")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files under a folder of any store that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def headers(files: DataFrame) -> DataFrame:
    """``files`` with format, width and height from the first bytes, by expressions on them; unknown formats have nulls."""
    head = F.hex(F.substring("content", 1, 32))
    number = lambda at, n: F.conv(F.substring(head, 2 * at + 1, 2 * n), 16, 10).cast("int")
    turned = lambda at: F.conv(F.concat(F.substring(head, 2 * at + 3, 2), F.substring(head, 2 * at + 1, 2)), 16, 10).cast("int")
    form = F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("47494638"), "gif").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("5036") | head.startswith("5033"), "ppm")
    line = F.regexp_extract(F.decode(F.substring("content", 1, 32), "ISO-8859-1"), r"^P[36]\s+(\d+)\s+(\d+)", 0)
    size = lambda i: F.regexp_extract(line, r"^P[36]\s+(\d+)\s+(\d+)", i).try_cast("int")
    return files.withColumn("format", form).withColumns({
        "width": F.when(F.col("format") == "png", number(16, 4)).when(F.col("format") == "gif", turned(6)).when(F.col("format") == "ppm", size(1)),
        "height": F.when(F.col("format") == "png", number(20, 4)).when(F.col("format") == "gif", turned(8)).when(F.col("format") == "ppm", size(2)),
    })


def read_memory(spark: SparkSession, path: str, items: str, schema_id: str, key: str = "id") -> DataFrame:
    """The items of a JSON memory, with ordinal, their place in the file. Another schema id, or a repeated key with other content, is an error."""
    kind = f"schema string, notes string, items array<struct<{items}>>"
    raw = spark.read.schema(T.StructType.fromDDL(kind)).option("multiLine", True).option("mode", "FAILFAST").json(path)
    checked = raw.select(F.when(F.col("schema") == schema_id, F.col("items")).otherwise(F.raise_error(F.concat(F.lit("another schema: "), F.coalesce("schema", F.lit("none"))))).alias("items"))
    rows = checked.select(F.posexplode("items").alias("ordinal", "item")).select("ordinal", "item.*")
    names = [c for c in rows.columns if c != "ordinal"]
    merged = rows.groupBy(*names).agg(F.min("ordinal").alias("ordinal"))
    twice = F.count("*").over(Window.partitionBy(key)) > 1
    return merged.withColumn("__ok", F.when(twice, F.raise_error(F.lit("one key, different items"))).otherwise(True)).where("__ok").drop("__ok")


def append_ledger(records: DataFrame, path: str) -> None:
    """Appends records to a folder of JSON lines; one that is longer than ``RECORD`` bytes is an error."""
    line = F.to_json(F.struct(*records.columns))
    checked = records.select(F.when(F.octet_length(line) <= RECORD, line).otherwise(F.raise_error(F.lit("a record is too long"))).alias("value"))
    checked.write.mode("append").text(path)


def read_ledger(spark: SparkSession, path: str, schema: str, order: str, tail: int | None = None) -> DataFrame:
    """The records of a ledger that can be read, the last ``tail`` in ``order`` if given; broken lines are left out."""
    kind = T.StructType.fromDDL(schema).add("_broken", T.StringType())
    rows = spark.read.schema(kind).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    # a file cache keeps the parser from leaving out the column that it asks about
    rows = rows.where(F.col("_broken").isNull() & F.col(order).isNotNull()).drop("_broken")
    return rows.orderBy(F.desc(order)).limit(tail) if tail is not None else rows
