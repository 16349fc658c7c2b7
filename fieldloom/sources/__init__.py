"""Readers and writers of dense arrays and result documents."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gamma_in_name, layer_in_name, time_in_name
from ..operators.linear import Probe


def decode_npy(data: bytes) -> np.ndarray:
    """A float32 matrix; raw two-byte cells are half floats, and a middle axis of length 1 is dropped."""
    x = np.load(io.BytesIO(data), allow_pickle=False)
    if x.dtype.kind == "V" and x.dtype.itemsize == 2:
        x = x.view(np.float16)
    if x.ndim == 3 and x.shape[1] == 1:
        x = x[:, 0]
    if x.ndim != 2:
        raise ValueError(f"a matrix was expected, not {x.shape}")
    return x.astype(np.float32)


def read_activations(spark: SparkSession, path: str, skip_bad: bool = True) -> DataFrame:
    """Rows ``ts, layer, node, x`` of all ``.npy`` files below a path; a file is decoded in one task.

    Undecodable files are left out, or raise if ``skip_bad`` is false.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.select(time_in_name(name).alias("ts"), layer_in_name(name).alias("layer"), "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                try:
                    x = decode_npy(batch.column(2)[k].as_py())
                except (ValueError, EOFError, OSError):  # no array, an empty file, a cut one
                    if skip_bad:
                        continue
                    raise
                row = pa.array(np.full(len(x), k))
                values = pa.ListArray.from_arrays(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(np.arange(len(x), dtype=np.int32)), values], names=["ts", "layer", "node", "x"])

    return files.mapInArrow(decode, "ts timestamp, layer int, node int, x array<float>")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a line; those that can't be read come out null."""
    return spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("d")).select("d.*")


def write_days(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Parquet by date; days that come again replace those that are there, others stay."""
    out = df.withColumn("date", F.to_date(ts)).repartition("date")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("date").parquet(path)


def write_parts(df: DataFrame, path: str, key: str) -> None:
    """Parquet by key with replacement of the keys given: what resumes after a stop."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_documents(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def still_to_do(wanted: DataFrame, done: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Wanted keys without output; with ``parts``, without so many rows of output."""
    have = done.groupBy(*keys).agg(F.count("*").alias("_n"))
    if parts is not None:
        have = have.filter(F.col("_n") >= parts)
    return wanted.join(have.select(*keys), keys, "left_anti")


def read_timestamps(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """A text list of times, a line each: ``i, ts``; an error if there are other than ``expected``."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\r?\n")).alias("i", "line"))
    out = lines.select("i", F.coalesce(F.try_to_timestamp("line"), time_in_name(F.col("line"))).alias("ts"))
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{n} times for {expected} steps")
    return out


def read_mesh_fields(spark: SparkSession, root: str, times: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Rows ``feature, ts, node, value`` of ``<root>/<feature>.npy`` arrays [time, node] (or [node], for every time once with a null time).

    Only the files of the wanted features are opened; an error if there are none.
    ``times`` (``i, ts``) name the steps; a file is decoded in one task.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(root)
    files = files.withColumn("feature", F.regexp_extract("path", r"([^/]+)\.npy$", 1))
    files = files if features is None else files.filter(F.col("feature").isin(features))
    if not files.select("path").limit(1).count():
        raise ValueError(f"no fields below {root}")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.load(io.BytesIO(batch.column(1)[k].as_py()), allow_pickle=False)
                steps = [None] if x.ndim == 1 else range(len(x))
                for i, row in zip(steps, np.atleast_2d(x)):
                    n = len(row)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(n, k))), pa.array([i] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)), pa.array(row.astype(np.float32))], names=["feature", "i", "node", "value"])

    long = files.select("feature", "content").mapInArrow(decode, "feature string, i int, node int, value float")
    return long.join(times.select("i", "ts"), "i", "left").select("feature", "ts", "node", "value")


def discover_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """``file, gamma, center_time`` of the files whose names have both, in order of gamma; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))
    name = F.element_at(F.split("file", "/"), -1)
    return files.select("file", gamma_in_name(name).alias("gamma"), time_in_name(F.col("file")).alias("center_time")).filter("gamma IS NOT NULL AND center_time IS NOT NULL").orderBy("gamma", "file")


def cached_documents(spark: SparkSession, path: str, schema: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """What is stored at the path; made and stored if nothing readable is there, or if forced."""
    if not force:
        try:
            have = read_documents(spark, path, schema)
            if have.limit(1).count():
                return have
        except Exception as e:  # Spark has one class for all that it finds wrong with a query
            if "PATH_NOT_FOUND" not in str(e):
                raise
    write_documents(make(), path)
    return read_documents(spark, path, schema)


def save_probe(spark: SparkSession, probe: Probe, path: str) -> None:
    row = (probe.mean.tolist(), probe.std.tolist(), probe.coef.tolist(), float(probe.intercept))
    spark.createDataFrame([row], "mean array<double>, std array<double>, coef array<double>, intercept double").write.mode("overwrite").parquet(path)


def load_probe(spark: SparkSession, path: str) -> Probe:
    r = spark.read.parquet(path).first()
    return Probe(np.array(r.mean), np.array(r.std), np.array(r.coef), r.intercept)


def write_manifest(good: DataFrame, bad: DataFrame, path: str) -> None:
    """Two text lists below the path: the valid files, and the skipped ones with their counts, tab-separated."""
    write_csv(good, f"{path}/valid", "\t")
    write_csv(bad, f"{path}/skipped", "\t")


def bundle(paths: list[str], out: str) -> None:
    """A compressed archive of local result files; for the few small outputs of an analysis."""
    with tarfile.open(out, "w:gz") as tar:
        for p in paths:
            tar.add(p, arcname=p.rstrip("/").rsplit("/", 1)[-1])
