"""Data sources and documents: files written from rows, read back as they were."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quefrency.sources import artifacts, formats, recordings, telemetry
from tests.test_operators import mat5


@pytest.fixture(scope="module")
def iq(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("iq")
    rng = np.random.default_rng(1)
    held = {}
    for name, n in (("A_x_2G.bin", 1000), ("B_y_2G.bin", 256), ("C_z_2G.bin", 0)):
        held[name] = rng.integers(-32768, 32767, (n, 2)).astype("<i2")
        (folder / name).write_bytes(held[name].tobytes() + b"\x01\x02" * (name[0] == "B"))
    (folder / "notes.txt").write_text("no recording")
    formats.register(spark)
    return folder, held


def test_iq_format(spark, iq):
    folder, held = iq
    d = spark.read.format("iq").option("block", 256).load(str(folder))
    got = {}
    for r in d.collect():
        got[r.path.rsplit("/", 1)[-1], r.start] = np.column_stack([r.re, r.im])
    want = {(name, at): x[at : at + 256] / 32768 for name, x in held.items() for at in range(0, len(x), 256)}
    assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k].astype(np.float32)) for k in want)
    plain = {(r.path.rsplit("/", 1)[-1], r.start): r.re for r in recordings.read_iq(spark, str(folder), 256).collect()}
    assert {k: v.astype(np.float32).tolist() for k, v in ((k, got[k][:, 0]) for k in got)} == plain


def test_iq_format_leaves_out_blocks_before_reading(spark, iq):
    folder, held = iq
    reader = formats.IqReader({"path": str(folder), "block": "256"})
    assert len(reader.partitions()) == 5
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, IsNull

    path = next(p.path for p in reader.partitions() if "A_x" in p.path)
    asked = [GreaterThanOrEqual(("start",), 512), EqualTo(("path",), path), IsNull(("re",))]
    assert list(reader.pushFilters(asked)) == asked  # Spark applies them as well
    assert [(p.start, p.count) for p in reader.partitions()] == [(512, 256), (768, 232)]
    d = spark.read.format("iq").option("block", 256).load(str(folder)).where((F.col("start") >= 512) & (F.col("path") == path))
    assert sorted(r.start for r in d.collect()) == [512, 768] and d.rdd.getNumPartitions() == 2


def test_formats_refuse_what_they_cannot_read(spark, iq):
    with pytest.raises(Exception, match="give a path"):
        spark.read.format("iq").load().collect()
    with pytest.raises(Exception, match="at least one sample"):
        spark.read.format("iq").option("block", 0).load(str(iq[0])).collect()
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("mat").load("/nowhere").collect()


def test_mat_format(spark, iq, tmp_path):
    (tmp_path / "97.mat").write_bytes(mat5("X097_DE_time", [1, 2.5, 3], True))
    (tmp_path / "98.mat").write_bytes(mat5("other", [4], False))
    got = {r.path.rsplit("/", 1)[-1]: r.x for r in spark.read.format("mat").load(str(tmp_path)).collect()}
    assert got == {"97.mat": [1, 2.5, 3], "98.mat": None}
    assert spark.read.format("mat").option("suffix", "ther").load(str(tmp_path)).where("x is not null").count() == 1


DOCUMENT = '{"config": {"seed": 1, "x": [1, 2.50, 1e-5], "none": {}, "a.b": {"q\\"]": true}}, "rows": [{"v": null}, {"v": "é\\n"}, [], [[7]]], "big": 12345678901234567890, "": 3}'
LEAVES = {"config.seed": "1", "config.x[0]": "1", "config.x[1]": "2.50", "config.x[2]": "1e-5", "config.none": "{}", 'config["a.b"]["q\\"]"]': "true", "rows[0].v": "null", "rows[1].v": '"é\\n"', "rows[2]": "[]", "rows[3][0][0]": "7", "big": "12345678901234567890", '[""]': "3"}


def test_leaves_and_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(DOCUMENT)
    (tmp_path / "b.json").write_text("[10, [20]]")
    (tmp_path / "c.json").write_text("5")
    rows = artifacts.read_leaves(spark, str(tmp_path))
    of = lambda name: {r.path: r.value for r in rows.where(F.col("file").endswith(name)).collect()}
    assert of("a.json") == LEAVES and of("b.json") == {"[0]": "10", "[1][0]": "20"} and of("c.json") == {"": "5"}
    back = {r.file[-6:]: json.loads(r.text) for r in artifacts.documents(rows).collect()}
    assert back == {"a.json": json.loads(DOCUMENT), "b.json": [10, [20]], "c.json": 5}
    artifacts.write_documents(rows, str(tmp_path / "out"))
    assert sorted(map(repr, (json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()))) == sorted(map(repr, back.values()))
    d = spark.createDataFrame([(None,), ("{}",)], "t string")
    assert [r[0] for r in d.select(artifacts.leaves(F.col("t"))).collect()] == [None, [("", "{}")]]
    many = spark.createDataFrame([("k", f"a[{i}]", str(i)) for i in range(30)], "file string, path string, value string")
    assert json.loads(artifacts.documents(many).first().text) == {"a": list(range(30))}


def test_parquet_telemetry_keeps_the_order_of_the_file(spark, tmp_path):
    rows = [(float(i), 1.0, 2.0, d) for i, d in enumerate([5.0, 1.0, None, 1.0, 9.0, 0.5, 1.0])]
    spark.createDataFrame(rows, "rpm double, tqa double, rop5 double, dept double").coalesce(1).write.parquet(str(tmp_path / "t"))
    got = [(r.rpm, r.depth) for r in telemetry.read_parquet_telemetry(spark, str(tmp_path / "t")).orderBy("rpm").collect()]
    assert got == [(0.0, 5.0), (3.0, 1.0), (5.0, 0.5)]
