"""NumPy files as data sources: ranges, types, archives, mount tables, memory."""

import subprocess
import sys

import numpy as np
import pytest
from pyspark.errors import PySparkException

from corpusmetrics.sources import numpy_source as NS
from corpusmetrics.sources import readers

M = np.arange(60, dtype=np.float32).reshape(12, 5) / 8


def rows(df):
    return {r["row_idx"]: r["vec"] for r in df.collect()}


@pytest.mark.parametrize("dtype", ["<f4", "<f8", ">f4", "<f2", "<i4", "u1"])
def test_types(spark, tmp_path, dtype):
    m = (M * 8).astype(dtype)
    np.save(tmp_path / "m.npy", m)
    assert rows(readers.matrix(spark, str(tmp_path / "m.npy"))) == {i: [float(x) for x in r] for i, r in enumerate(m)}


def test_ranges_are_partitions(spark, tmp_path):
    """Ranges of two rows and a last one of one; every row once, by its own place."""
    np.save(tmp_path / "m.npy", M[:11])
    df = NS.read_numpy(spark, str(tmp_path / "m.npy"), range_bytes=2 * 20)
    assert df.rdd.getNumPartitions() == 6
    assert rows(df) == {i: r.tolist() for i, r in enumerate(M[:11])}
    assert df.where("row_idx = 7").count() == 1


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_archives(spark, tmp_path, save):
    """Stored entries are read by ranges, compressed ones as streams."""
    save(tmp_path / "f.npz", **{"low|a|purpose": M, "high|b|mechanism": M[:3] * 2, "low|é|purpose": M[:0]})
    got = NS.read_numpy(spark, str(tmp_path / "f.npz"), range_bytes=100).collect()
    want = {("purpose", "a", "low", i): r.tolist() for i, r in enumerate(M)} | {("mechanism", "b", "high", i): (2 * r).tolist() for i, r in enumerate(M[:3])}
    assert {tuple(r)[:4]: r["vec"] for r in got} == want and len(got) == 15


def test_mount_tables(spark, tmp_path):
    """A viewfs path, which only the session can resolve."""
    np.save(tmp_path / "m.npy", M)
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.numpytest.link./data", f"file://{tmp_path}")
    assert rows(readers.matrix(spark, "viewfs://numpytest/data/m.npy")) == {i: r.tolist() for i, r in enumerate(M)}
    assert rows(readers.matrix(spark, f"file://{tmp_path}/m.npy")) == {i: r.tolist() for i, r in enumerate(M)}


def test_empty_and_wrong_files(spark, tmp_path):
    np.save(tmp_path / "none.npy", M[:0])
    assert readers.matrix(spark, str(tmp_path / "none.npy")).collect() == []
    np.save(tmp_path / "flat.npy", M.ravel())
    np.save(tmp_path / "columns.npy", np.asfortranarray(M))
    for name in ("flat", "columns"):
        with pytest.raises(PySparkException, match="row by row"):
            readers.matrix(spark, str(tmp_path / f"{name}.npy")).collect()
    np.save(tmp_path / "cut.npy", M)
    whole = (tmp_path / "cut.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(whole[:-8])
    with pytest.raises(PySparkException, match="ends before row"):
        readers.matrix(spark, str(tmp_path / "cut.npy")).collect()
    with pytest.raises(Exception, match="no.npy"):
        readers.matrix(spark, str(tmp_path / "no.npy"))


def test_a_gigabyte_needs_little_memory(tmp_path):
    """All partitions of a sparse 1 GB file, one after the other in one process."""
    np.lib.format.open_memmap(tmp_path / "big.npy", mode="w+", dtype=np.float32, shape=(1_000_000, 250)).flush()
    code = (
        "import resource, sys\nfrom corpusmetrics.sources.numpy_source import MatrixReader\nr = MatrixReader({'path': sys.argv[1]})\nparts = r.partitions()\n"
        "n = sum(b.num_rows for p in parts for b in r.read(p))\nprint(len(parts), n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1000)"
    )
    parts, n, mb = map(int, subprocess.run([sys.executable, "-c", code, str(tmp_path / "big.npy")], capture_output=True, text=True, check=True).stdout.split())
    assert parts == 16 and n == 1_000_000 and mb < 300
