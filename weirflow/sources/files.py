"""Readers and writers beside Spark's own: directory listings, frame text files, wide-matrix files, stores."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Longest column name of a MAT v5 struct.
MAT_NAME = 31


def list_files(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """(path, name, modified, length) of files below a folder with an extension; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension.lstrip('.')}").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), "length")


def read_frames(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    """Text frames as (frame, row, col, value): blocks of number rows that blank lines part.

    `frame` counts blank runs before a line within its file, lines being read whole per file."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = spark.read.text(path, wholetext=True)
    frames = lines.select(F.posexplode(F.split(bare("value"), r"\n\s*\n")).alias("frame", "body"))
    rows = frames.select("frame", F.posexplode(F.split(bare("body"), r"\n")).alias("row", "line"))
    cells = rows.select("frame", "row", F.posexplode(F.split(bare("line"), separator)).alias("col", "text"))
    return cells.select(*(F.col(c).cast("long").alias(c) for c in ("frame", "row", "col")), F.col("text").cast("double").alias("value"))


def check_mat_names(df: DataFrame) -> None:
    """Raise for columns whose names a MAT v5 file cannot hold."""
    long = [c for c in df.columns if len(c) > MAT_NAME]
    if long:
        raise ValueError(f"names over {MAT_NAME} characters: {long}")


_MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_MAT_CLASSES = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}


def _elements(data: bytes):
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<II", data, at)
        if kind >> 16:
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + (size if kind == 15 else -(-size // 8) * 8)


def mat_arrays(data: bytes) -> dict[str, np.ndarray]:
    """Numeric arrays of a little-endian MAT v5 file by name."""
    if data[126:128] != b"IM":
        raise ValueError("not a little-endian MAT v5 file")
    found = {}
    for kind, body in _elements(data[128:]):
        if kind == 15:
            ((kind, body),) = list(_elements(zlib.decompress(body)))[:1]
        if kind != 14:
            continue
        parts = list(_elements(body))
        cls = struct.unpack("<I", parts[0][1][:4])[0] & 0xFF
        if cls in _MAT_CLASSES:
            shape = np.frombuffer(parts[1][1], "<i4")
            values = np.frombuffer(parts[3][1], "<" + _MAT_TYPES[parts[3][0]])
            found[parts[2][1].decode()] = values.reshape(shape, order="F").astype(_MAT_CLASSES[cls])
    return found


def read_mat(spark: SparkSession, path: str) -> DataFrame:
    """Numeric arrays of MAT v5 files as (path, name, row, col, value); one file is read by one task."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for name, array in mat_arrays(bytes(content)).items():
                    flat = np.atleast_2d(array).reshape(array.shape[0], -1)
                    row, col = np.indices(flat.shape)
                    yield pd.DataFrame({"path": path, "name": name, "row": row.ravel(), "col": col.ravel(), "value": flat.ravel().astype(float)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, name string, row long, col long, value double")


def read_hdf(*_):
    """HDF5 needs a reader that is not installed; the interface says so plainly."""
    raise NotImplementedError("HDF5 files need the h5py package")
