"""Readers of vector files, distributed by file: fvecs, ivecs, bvecs and npy. They stream; no file is held whole."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_KINDS = {"fvecs": ("<f4", 4), "ivecs": ("<i4", 4), "bvecs": ("u1", 1)}
ROWS = 4096


def _opened(path: str):
    system, at = fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)
    return system.open_input_stream(at)


def _rows(path: str) -> Iterator[np.ndarray]:
    kind = path.rpartition(".")[2]
    with _opened(path) as f:
        if kind == "npy":
            if f.read(6) != b"\x93NUMPY":
                raise ValueError(f"{path} is no npy file")
            major = f.read(2)[0]
            head = f.read(int.from_bytes(f.read(2 if major == 1 else 4), "little")).decode("latin-1")
            if "'fortran_order': True" in head:
                raise ValueError(f"{path} is stored by columns")
            dtype = np.dtype(re.search(r"'descr': '([^']+)'", head)[1])
            shape = [int(x) for x in re.findall(r"\d+", re.search(r"'shape': \(([^)]*)\)", head)[1])]
            dim = shape[1] if len(shape) > 1 else 1
            while data := f.read(ROWS * dim * dtype.itemsize):
                yield np.frombuffer(data, dtype).reshape(-1, dim)
            return
        dtype, width = _KINDS[kind]
        first = f.read(4)
        while first:
            dim = int.from_bytes(first, "little")
            size = 4 + dim * width
            data = first + f.read(ROWS * size - 4)
            if len(data) % size:
                raise ValueError(f"{path} is cut off, or its rows differ in size")
            rows = np.frombuffer(data, np.uint8).reshape(-1, size)
            yield np.ascontiguousarray(rows[:, 4:]).view(dtype)
            first = f.read(4)


def read_vectors(spark: SparkSession, paths: list[str], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(path, row, vector): rows are numbered from 0 in each file. The kind of a file is its ending."""
    for p in paths:
        if p.rpartition(".")[2] not in (*_KINDS, "npy"):
            raise ValueError(f"{p}: the ending must be fvecs, ivecs, bvecs or npy")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                n = 0
                for x in _rows(path):
                    offs = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
                    vectors = pa.ListArray.from_arrays(pa.array(offs), pa.array(x.astype(np.float32).ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(x)), pa.array(np.arange(n, n + len(x))), vectors], names=["path", id_col, vector_col])
                    n += len(x)

    names = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return names.mapInArrow(read, f"path string, {id_col} long, {vector_col} array<float>")
