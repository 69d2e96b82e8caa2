import numpy as np
import pytest

from latticevec.sources import formats

SHAPES = [(3, 4), (1, 1), (0, 4), (50, 7)]


@pytest.fixture(scope="module")
def source(spark):
    formats.register(spark)
    return spark


def numbers(n, d):
    return np.arange(n * d).reshape(n, d) % 200


@pytest.mark.parametrize("kind", formats.KINDS)
@pytest.mark.parametrize("shape", SHAPES)
def test_read(source, tmp_path, kind, shape):
    x = numbers(*shape)
    (tmp_path / f"a.{kind}").write_bytes(formats.dump(x, kind))
    reader = source.read.format("vectors").option("part_bytes", 64)
    reader = reader.option("rows", shape[0]) if kind == "nsw" and shape[0] else reader
    if kind == "nsw" and not shape[0]:
        with pytest.raises(Exception, match="rows"):
            reader.load(str(tmp_path / f"a.{kind}")).collect()
        return
    rows = reader.load(str(tmp_path / f"a.{kind}")).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(shape[0]))
    assert [list(r["vec"]) for r in rows] == x.tolist()


@pytest.mark.parametrize("kind", [k for k in formats.KINDS if k != "nsw"])
def test_write_and_merge(source, tmp_path, kind):
    x = numbers(20, 5)
    df = source.createDataFrame([(i, [int(v) for v in r] if kind == "ivecs" else [float(v) for v in r]) for i, r in enumerate(x)], f"id long, vec array<{'int' if kind == 'ivecs' else 'float'}>")
    df.repartitionByRange(3, "id").sortWithinPartitions("id").write.format("vectors").option("kind", kind).mode("append").save(str(tmp_path / "out"))
    formats.merge(str(tmp_path / "out"), str(tmp_path / f"one.{kind}"))
    for where in ("out", f"one.{kind}"):
        rows = source.read.format("vectors").option("kind", kind).load(str(tmp_path / where)).orderBy("id").collect()
        assert [list(r["vec"]) for r in rows] == x.tolist()


def test_errors(source, tmp_path):
    (tmp_path / "a.fbin").write_bytes(formats.dump(numbers(3, 4), "fbin")[:-1])
    with pytest.raises(Exception, match="whole number"):
        source.read.format("vectors").load(str(tmp_path / "a.fbin")).collect()
    with pytest.raises(Exception, match="unknown kind"):
        source.read.format("vectors").load(str(tmp_path / "a.xyz")).collect()
    (tmp_path / "g.nsw").write_bytes(formats.dump(numbers(3, 4), "nsw"))
    with pytest.raises(Exception, match="whole number"):
        source.read.format("vectors").option("rows", 5).load(str(tmp_path / "g.nsw")).collect()
    mixed = formats.dump(numbers(1, 4), "fvecs") + formats.dump(numbers(1, 3), "fvecs") + b"\0" * 4
    (tmp_path / "m.fvecs").write_bytes(mixed)
    with pytest.raises(Exception, match="whole number|different"):
        source.read.format("vectors").load(str(tmp_path / "m.fvecs")).collect()


def test_box_files(source, tmp_path):
    point = "struct<x: double, y: double, z: double>"
    rows = [(0, (0.0, 0.5, 1.0), (1.0, 1.0, 2.0), [0, 3, 4]), (1, (-1.0, 0.0, 0.25), (0.0, 0.0, 8.0), [1]), (2, (0.0,) * 3, (0.0,) * 3, [])]
    made = source.createDataFrame(rows, f"box_id int, lo {point}, hi {point}, members array<bigint>")
    formats.write_boxes(made, str(tmp_path / "a.aabbs"), 5)
    assert (tmp_path / "a.aabbs").stat().st_size == 8 + 3 * 24 + 3 * 3 * 4
    assert sorted(formats.read_boxes(source, str(tmp_path / "a.aabbs"), 5).collect()) == sorted(made.collect())
    (tmp_path / "a.aabbs").write_bytes(b"\1\0\0\0\1\0\0\0\0")
    with pytest.raises(ValueError, match="not 1 boxes"):
        formats.read_boxes(source, str(tmp_path / "a.aabbs"), 5)
