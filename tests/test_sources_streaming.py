import io

import numpy as np
from pyspark.sql import functions as F

from fieldloom import sources as so
from fieldloom import streaming as st


def _npy(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, x)
    return out.getvalue()


def test_activation_files(spark, tmp_path):
    x = np.arange(6, dtype=np.float16).reshape(3, 1, 2)
    raw = np.frombuffer(x.tobytes(), dtype="V2").reshape(3, 1, 2)
    (tmp_path / "layer0008_t2021-01-01T06.npy").write_bytes(_npy(raw))
    (tmp_path / "layer0009_t2021-01-02.npy").write_bytes(_npy(x[:, 0].astype(np.float32)))
    (tmp_path / "bad_t2021-01-03T00.npy").write_bytes(b"nothing")
    got = so.read_activations(spark, str(tmp_path)).orderBy("ts", "node").collect()
    assert len(got) == 6 and list(got[1].x) == [2.0, 3.0] and got[0].layer == 8 and str(got[3].ts) == "2021-01-02 00:00:00"


def test_writers_and_resume(spark, tmp_path):
    df = spark.sql("SELECT explode(sequence(timestamp'2021-01-01', timestamp'2021-01-02 18:00:00', interval 6 hours)) AS ts, 1 AS v")
    path = str(tmp_path / "days")
    so.write_days(df, path)
    so.write_days(df.filter("ts < timestamp'2021-01-01 12:00:00'"), path)  # replaces one day, keeps the other
    back = spark.read.parquet(path)
    assert back.count() == 6
    todo = so.still_to_do(df.select(F.to_date("ts").alias("date")).distinct(), back, ["date"], parts=4)
    assert [str(r.date) for r in todo.collect()] == ["2021-01-01"]
    so.write_csv(df, str(tmp_path / "csv"), "\t")
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "csv")).count() == 8
    so.write_documents(df, str(tmp_path / "json"))
    assert so.read_documents(spark, str(tmp_path / "json"), "v int").agg(F.sum("v")).first()[0] == 8


def test_streams(spark, tmp_path):
    df = spark.sql("SELECT explode(sequence(timestamp'2021-01-01', timestamp'2021-01-04', interval 6 hours)) AS ts").withColumn("x", F.array(F.rand(1), F.rand(2)))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    running = st.RunningGram("x")
    st.each_new(stream, running, str(tmp_path / "c1")).awaitTermination(60)
    assert running.n == 13 and len(running.variances()) == 2
    q = st.three_step_windows(stream, "ts", "0 seconds").writeStream.format("memory").queryName("three").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    starts = {str(r.start) for r in spark.table("three").collect()}
    assert "2021-01-01 06:00:00" in starts and "2020-12-31 18:00:00" not in starts


def test_fields_forecasts_and_probes(spark, tmp_path):
    import pytest

    (tmp_path / "f").mkdir()
    (tmp_path / "f/t2m.npy").write_bytes(_npy(np.arange(6, dtype=np.float32).reshape(2, 3)))
    (tmp_path / "f/lsm.npy").write_bytes(_npy(np.ones(3, np.float32)))
    (tmp_path / "times.txt").write_text("2021-01-01 00:00:00\n2021-01-01T06\n")
    times = so.read_timestamps(spark, str(tmp_path / "times.txt"), 2)
    assert [str(r.ts) for r in times.orderBy("i").collect()] == ["2021-01-01 00:00:00", "2021-01-01 06:00:00"]
    with pytest.raises(ValueError):
        so.read_timestamps(spark, str(tmp_path / "times.txt"), 3)
    got = {(r.feature, str(r.ts), r.node): r.value for r in so.read_mesh_fields(spark, str(tmp_path / "f"), times).collect()}
    assert len(got) == 9 and got["t2m", "2021-01-01 06:00:00", 2] == 5.0 and got["lsm", "None", 0] == 1.0
    assert so.read_mesh_fields(spark, str(tmp_path / "f"), times, ["lsm"]).count() == 3
    with pytest.raises(ValueError):
        so.read_mesh_fields(spark, str(tmp_path / "f"), times, ["absent"])
    (tmp_path / "p/2021-03-04T06").mkdir(parents=True)
    for n in ("gamma_0.5.nc", "gamma_-1.nc", "other.nc"):
        (tmp_path / "p/2021-03-04T06" / n).write_bytes(b"x")
    found = so.discover_forecasts(spark, str(tmp_path / "p")).collect()
    assert [(r.gamma, str(r.center_time)) for r in found] == [(-1.0, "2021-03-04 06:00:00"), (0.5, "2021-03-04 06:00:00")]
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for force in (False, False, True):
        assert so.cached_documents(spark, str(tmp_path / "cache"), "id long", make, force).count() == 3
    assert len(made) == 2
    probe = so.Probe(np.array([1.0]), np.array([2.0]), np.array([3.0]), 4.0)
    so.save_probe(spark, probe, str(tmp_path / "probe"))
    back = so.load_probe(spark, str(tmp_path / "probe"))
    assert (back.mean, back.std, back.coef, back.intercept) == (probe.mean, probe.std, probe.coef, 4.0)
    so.write_manifest(spark.range(2), spark.range(1), str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m/valid")).count() == 2
    so.bundle([str(tmp_path / "times.txt")], str(tmp_path / "out.tar.gz"))
    import tarfile

    assert tarfile.open(tmp_path / "out.tar.gz").getnames() == ["times.txt"]
    (tmp_path / "act").mkdir()
    (tmp_path / "act/empty_t2021-01-03T00.npy").write_bytes(b"")
    assert so.read_activations(spark, str(tmp_path / "act")).count() == 0


def test_running_gram_survives_a_restart(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "i int, x array<double>")
    path = str(tmp_path / "sums")
    one = st.RunningGram("x", spark, path)
    one(df, 0)
    one(df, 0)
    two = st.RunningGram("x", spark, path)
    assert one.n == two.n == 10
    two(df.limit(4), 1)
    again = st.RunningGram("x", spark, path)
    assert again.n == 14 and np.allclose(again.total, [45 + 6, 14]) and len(again.variances()) == 2


def test_days_and_sessions(spark, tmp_path):
    t = spark.sql("SELECT explode(sequence(timestamp'2021-01-01', timestamp'2021-01-04', interval 6 hours)) AS ts, 'a' AS k").filter("ts <> timestamp'2021-01-02 06:00:00'")
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    for name, df in (("days", st.daily_counts(stream, "ts", expected=4)), ("own", st.sessions(stream, "ts", "k", "7 hours"))):
        df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination(60)
    assert {str(r.day): r.n for r in spark.table("days").collect()} == {"2021-01-02 00:00:00": 3, "2021-01-04 00:00:00": 1}
    assert sorted(r.n for r in spark.table("own").collect()) == [5, 7]


def test_results_of_streams_stay_off_the_driver(spark, tmp_path):
    from fieldloom import catalog

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("stream_sessions", "stream_daily_counts"):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        files = got.inputFiles()
        assert files and not any("/state/" in f for f in files)  # a memory sink has its rows on the driver, and no files
        assert sorted(got.collect()) == sorted(catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect())


def test_zarr_chunks(spark, tmp_path):
    import json
    import zlib

    root = tmp_path / "store"
    x = np.arange(5 * 7, dtype="<f4").reshape(5, 7)
    x[1, 2] = -9

    def put(name, array, chunks, dims, compressor, attrs=None):
        d = root / name
        d.mkdir(parents=True)
        (d / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": array.shape, "chunks": chunks, "dtype": array.dtype.str, "compressor": compressor, "fill_value": None, "order": "C", "filters": None}))
        (d / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims, **(attrs or {})}))
        for at in np.ndindex(*[-(-n // c) for n, c in zip(array.shape, chunks)]):
            part = np.zeros(chunks, array.dtype)
            own = array[tuple(slice(k * c, k * c + c) for k, c in zip(at, chunks))]
            part[tuple(slice(0, n) for n in own.shape)] = own
            raw = part.tobytes()
            raw = zlib.compress(raw) if compressor and compressor["id"] == "zlib" else raw if compressor is None else __import__("pyarrow").compress(raw, codec="zstd", asbytes=True)
            (d / ".".join(map(str, at))).write_bytes(raw)

    put("t", x, [2, 3], ["latitude", "longitude"], {"id": "zlib"}, {"missing_value": -9, "scale_factor": 2.0, "add_offset": 1.0})
    put("u", x, [5, 7], ["latitude", "step"], {"id": "zstd"})
    put("latitude", np.linspace(90, -90, 5), [2], ["latitude"], None)
    put("longitude", np.arange(7) * 10.0, [7], ["longitude"], {"id": "zlib"})
    from fieldloom.sources import grids

    got = {(r.lat, r.lon): r.value for r in grids.read_zarr(spark, str(root), "t").collect()}
    assert len(got) == 35 and got[45.0, 20.0] is None and got[-90.0, 60.0] == 34 * 2 + 1.0 and got[90.0, 10.0] == 3.0
    u = {(r.lat, r.step): r.value for r in grids.read_zarr(spark, str(root), "u").collect()}
    assert len(u) == 35 and u[0.0, 3.0] == 17.0


def test_classic_netcdf(spark, tmp_path):
    import struct

    import pytest

    from fieldloom.sources import grids

    def name(s):
        return struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")

    def build(time):
        """CDF-1 with a record dimension ``time``, and ``latitude``; two record variables, one of shorts with scale and fill."""
        lat, t = np.array([10.0, 20.0, 30.0], ">f8"), (np.arange(time) * 6).astype(">i4")
        mask = (np.arange(time * 3).reshape(time, 3) % 4).astype(">i2")
        attr = struct.pack(">ii", 12, 2) + name("scale_factor") + struct.pack(">iid", 6, 1, 0.5) + name("_FillValue") + struct.pack(">iih", 3, 1, 3) + b"\0\0"
        none = struct.pack(">ii", 0, 0)

        def head(begin):
            v = name("latitude") + struct.pack(">ii", 1, 1) + none + struct.pack(">iii", 6, 24, begin[0])
            v += name("time") + struct.pack(">ii", 1, 0) + none + struct.pack(">iii", 4, 4, begin[1])
            v += name("label") + struct.pack(">iii", 2, 0, 1) + attr + struct.pack(">iii", 3, 8, begin[2])
            return b"CDF\1" + struct.pack(">i", time) + struct.pack(">ii", 10, 2) + name("time") + struct.pack(">i", 0) + name("latitude") + struct.pack(">i", 3) + none + struct.pack(">ii", 11, 3) + v

        n = len(head([0, 0, 0]))
        out = head([n, n + 24, n + 28]) + lat.tobytes()
        for k in range(time):
            out += t[k : k + 1].tobytes() + mask[k].tobytes() + b"\0\0"
        return out, mask

    data, mask = build(2)
    (tmp_path / "2021-01-01.nc").write_bytes(data)
    (tmp_path / "hdf.nc").write_bytes(b"\x89HDF")
    (tmp_path / "empty.nc").write_bytes(b"")
    got = {(r.time, r.lat): (r.value, r.annotator) for r in grids.read_netcdf(spark, str(tmp_path), "label", ["time", "lat", "annotator"]).collect()}
    assert sorted(got) == [(a, b) for a in (0.0, 6.0) for b in (10.0, 20.0, 30.0)]
    assert got[0.0, 10.0] == (0.0, None) and got[6.0, 10.0] == (None, None) and got[6.0, 30.0] == (0.5 * mask[1, 2], None)
    assert grids.read_netcdf(spark, str(tmp_path), "absent", ["time"]).count() == 0
    with pytest.raises(Exception):
        grids.read_netcdf(spark, str(tmp_path), "label", ["time"], skip_bad=False).count()
