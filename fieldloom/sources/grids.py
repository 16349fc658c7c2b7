"""Gridded files as long rows: chunked arrays in folders (Zarr, version 2) and classic NetCDF (CDF-1, CDF-2 and CDF-5).

A chunk, or a file, is decoded in one task. Fill values come out null, and scale
and offset attributes are applied.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAMES = {"latitude": "lat", "longitude": "lon"}


def _values(raw: np.ndarray, attrs: dict) -> tuple[np.ndarray, np.ndarray]:
    """Decoded doubles, and which of them are missing."""
    x = raw.astype(np.float64)
    missing = ~np.isfinite(x)
    for key in ("_FillValue", "missing_value"):
        if attrs.get(key) is not None:
            missing |= raw == np.asarray(attrs[key]).ravel()[0]
    return x * float(np.ravel(attrs.get("scale_factor", 1.0))[0]) + float(np.ravel(attrs.get("add_offset", 0.0))[0]), missing


def _inflate(data: bytes, compressor: dict | None, size: int) -> bytes:
    kind = (compressor or {}).get("id")
    if kind is None:
        return data
    if kind in ("zlib", "gzip"):
        return zlib.decompress(data, 47)
    if kind in ("zstd", "lz4"):
        raw = pa.decompress(data[4:] if kind == "lz4" else data, decompressed_size=size, codec="zstd" if kind == "zstd" else "lz4_raw", asbytes=True)
        return raw
    raise ValueError(f"chunks compressed by {kind} can't be read")


def _hidden(spark: SparkSession, path: str) -> str | None:
    """The text of a small file that Spark's readers pass over for its name; None if there is none."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_zarr(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """Rows of one variable: its dimensions' coordinates (the index where there is no coordinate array) and ``value``.

    ``latitude`` and ``longitude`` come as ``lat`` and ``lon``. Coordinates are
    small and read on the driver; only chunks of the variable are read besides.
    Chunks that aren't stored hold the fill value, so they give no rows.
    """

    def meta(name: str) -> tuple[dict, dict]:
        return tuple(json.loads(_hidden(spark, f"{path}/{name}/{k}") or "{}") for k in (".zarray", ".zattrs"))

    def shape_of(array: dict) -> tuple[np.dtype, list[int]]:
        if array.get("filters") or array.get("order", "C") != "C":
            raise ValueError("filters and column order can't be read")
        return np.dtype(array["dtype"]), array["chunks"]

    array, attrs = meta(variable)
    if not array:
        raise ValueError(f"no array {variable} in {path}")
    kind, chunks = shape_of(array)
    fill = array.get("fill_value")
    attrs = {"_FillValue": fill, **attrs} if fill not in (None, "NaN") else attrs
    dims = attrs.get("_ARRAY_DIMENSIONS", [f"dim_{k}" for k in range(len(chunks))])
    axes = []
    for d, n in zip(dims, array["shape"]):
        own, own_attrs = meta(d)
        if not own:
            axes.append(np.arange(n, dtype=np.float64))
            continue
        t, c = shape_of(own)
        parts = spark.read.format("binaryFile").load(f"{path}/{d}/[0-9]*").select("path", "content").collect()
        parts.sort(key=lambda r: int(r.path.rsplit("/", 1)[-1]))
        axes.append(_values(np.concatenate([np.frombuffer(_inflate(r.content, own.get("compressor"), c[0] * t.itemsize), t) for r in parts])[:n], own_attrs)[0])
    names = [_NAMES.get(d, d) for d in dims]
    shape, compressor, sep = array["shape"], array.get("compressor"), array.get("dimension_separator", ".")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/{variable}").filter(~F.col("path").rlike(r"/\.z[a-z]+$"))
    tail = len(f"/{variable}/")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = int(np.prod(chunks)) * kind.itemsize
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = [int(k) for k in p[p.rindex(f"/{variable}/") + tail :].split(sep)]
                raw = np.frombuffer(_inflate(data, compressor, size), kind).reshape(chunks)
                raw = raw[tuple(slice(0, max(0, n - k * c)) for k, c, n in zip(at, chunks, shape))]
                x, missing = _values(raw, attrs)
                grid = np.meshgrid(*[a[k * c : k * c + m] for a, k, c, m in zip(axes, at, chunks, raw.shape)], indexing="ij")
                yield pa.RecordBatch.from_arrays([*[pa.array(g.ravel()) for g in grid], pa.array(x.ravel(), mask=missing.ravel())], names=[*names, "value"])

    return files.select("path", "content").mapInArrow(decode, ", ".join(f"`{n}` double" for n in names) + ", value double")


_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


def decode_netcdf(data: bytes) -> dict[str, tuple[list[str], np.ndarray, dict]]:
    """Dimensions, values as stored and attributes of each variable of a classic NetCDF file."""
    if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
        raise ValueError("no classic NetCDF file")
    wide, at = data[3] == 5, 4

    def number(form: str) -> int:
        nonlocal at
        (v,) = struct.unpack_from(form, data, at)
        at += struct.calcsize(form)
        return v

    count = lambda: number(">q" if wide else ">i")

    def name() -> str:
        nonlocal at
        n = count()
        text = data[at : at + n].decode()
        at += -(-n // 4) * 4
        return text

    def entries(read) -> list:
        tag, n = number(">i"), count()
        return [read() for _ in range(n)] if tag else []

    def attribute():
        nonlocal at
        key, kind, n = name(), np.dtype(_TYPES[number(">i")]), count()
        raw = data[at : at + n * kind.itemsize]
        at += -(-len(raw) // 4) * 4
        return key, raw.decode("utf-8", "replace") if kind.kind == "S" else np.frombuffer(raw, kind)

    records = max(0, count())
    dims = entries(lambda: (name(), count()))
    entries(attribute)

    def variable():
        key, ids = name(), [count() for _ in range(count())]
        attrs, kind, size = dict(entries(attribute)), np.dtype(_TYPES[number(">i")]), count()
        return key, ids, attrs, kind, size, number(">i" if data[3] == 1 else ">q")

    variables = entries(variable)
    moving = [v for v in variables if v[1] and dims[v[1][0]][1] == 0]
    pad = lambda n: n if len(moving) == 1 else -(-n // 4) * 4
    length = {v[0]: int(np.prod([dims[k][1] for k in v[1][1:]], dtype=np.int64)) * v[3].itemsize for v in moving}
    step = sum(pad(n) for n in length.values())
    out = {}
    for key, ids, attrs, kind, _, begin in variables:
        shape = [dims[k][1] for k in ids]
        if key in length:
            shape[0] = records
            raw = b"".join(data[begin + r * step : begin + r * step + length[key]] for r in range(records))
        else:
            raw = data[begin : begin + int(np.prod(shape, dtype=np.int64)) * kind.itemsize]
        out[key] = ([dims[k][0] for k in ids], np.frombuffer(raw, kind).reshape(shape), attrs)
    return out


def read_netcdf(spark: SparkSession, path: str, variable: str, dims: list[str], skip_bad: bool = True) -> DataFrame:
    """Rows ``file``, the named dimensions' coordinates (``lat`` and ``lon`` for their long names) and ``value`` of a variable of every ``.nc`` file.

    A dimension without a coordinate variable gives its index, and one that the
    variable doesn't have null. Files that aren't classic NetCDF (HDF5 ones among
    them), or lack the variable, are left out, or raise if ``skip_bad`` is false.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.nc").option("recursiveFileLookup", "true").load(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                try:
                    have = decode_netcdf(batch.column(1)[k].as_py())
                    own, raw, attrs = have[variable]
                except (ValueError, KeyError, IndexError, struct.error):
                    if skip_bad:
                        continue
                    raise
                x, missing = _values(raw, attrs)
                axes = [_values(have[d][1], have[d][2])[0] if d in have and have[d][1].ndim == 1 else np.arange(n, dtype=np.float64) for d, n in zip(own, raw.shape)]
                grid = dict(zip([_NAMES.get(d, d) for d in own], np.meshgrid(*axes, indexing="ij")))
                columns = [pa.array(grid[d].ravel()) if d in grid else pa.nulls(x.size, pa.float64()) for d in dims]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(x.size, k))), *columns, pa.array(x.ravel(), mask=missing.ravel())], names=["file", *dims, "value"])

    return files.select("path", "content").mapInArrow(decode, "file string, " + ", ".join(f"`{d}` double" for d in dims) + ", value double")
