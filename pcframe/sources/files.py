"""File sources: PLY point files and text matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scalar type names of PLY headers and their sizes and kinds (fixed values of the format).
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2",
    "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8",
}


def parse_ply(data: bytes) -> np.ndarray:
    """float32 (N, 3): the vertices of an ASCII or binary little-endian PLY file, in which x, y, z
    are the first vertex properties and vertices the first element."""
    end = data.find(b"end_header")
    if end < 0:
        raise ValueError("PLY: no end_header")
    body = data.index(b"\n", end) + 1
    lines = data[:end].decode("ascii", "replace").splitlines()
    if not lines or lines[0].strip() != "ply":
        raise ValueError("not a PLY file")
    kind, count, fields, inside = "", None, [], False
    for words in (line.split() for line in lines[1:]):
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            inside = words[1] == "vertex"
            count = int(words[2]) if inside else count
        elif words[:1] == ["property"] and inside:
            if words[1] not in PLY_TYPES:
                raise ValueError(f"PLY: unsupported property type {words[1]}")
            fields.append((words[2], PLY_TYPES[words[1]]))
    if not count:
        raise ValueError("PLY: no vertices")
    if [f[0] for f in fields[:3]] != ["x", "y", "z"]:
        raise ValueError("PLY: x, y, z must be the first vertex properties")
    if kind == "ascii":
        rows = data[body:].split(b"\n", count)[:count]
        return np.array([r.split()[:3] for r in rows], np.float32).reshape(-1, 3)
    if kind != "binary_little_endian":
        raise ValueError(f"PLY: unsupported format {kind}")
    vertices = np.frombuffer(data, np.dtype(fields), count, body)
    return np.column_stack([vertices[c].astype(np.float32) for c in "xyz"])


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """path, row (from 0), x, y, z of every vertex of the PLY files at path; a file a task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                v = parse_ply(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), pa.array(np.arange(len(v))), *(pa.array(v[:, i]) for i in range(3))], ["path", "row", "x", "y", "z"])

    return files.mapInArrow(run, "path string, row long, x float, y float, z float")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """path, m (array<array<double>>): white-space separated text matrices, one a file; blank
    lines and comments from '#' are left out."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", "\r?\n").alias("lines"))
    rows = F.filter(F.transform("lines", lambda r: F.trim(F.regexp_replace(r, "#.*", ""))), lambda r: r != "")
    return text.select("path", F.transform(rows, lambda r: F.transform(F.split(r, r"\s+"), lambda v: v.cast("double"))).alias("m"))
