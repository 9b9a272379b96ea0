"""CSV records over line breaks, against Python's reader, with splits of a few bytes."""

import csv
import io
import random

import pytest

from weekgrid.sources import readers, records


def table(spark, tmp_path, name, data: bytes, split: int):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    costs = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        return [tuple(r) for r in readers.read_text_columns(spark, str(path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", costs)


@pytest.mark.parametrize("inside", [False, True])
@pytest.mark.parametrize("line, after", [
    ("a,b", (False, True)), ('a,"b', (True, False)), ('"a""b"', (False, False)), ('"', (True, False)), ('""', (False, True)), ('"""', (True, False)),
    ('5" x,2', (False, False)), ('x" , "y', (False, False)), ('x",2', (False, False)), ('x","y', (True, True)), ('x"z",y', (False, False)), (',",', (True, False)),
])
def test_lines_as_functions(line, after, inside):
    assert records.open_after(line, inside) == after[inside]


@pytest.mark.parametrize("split", [7, 61, 1000, 1 << 20])
def test_records_in_small_splits(spark, tmp_path, split):
    rng = random.Random(split)
    pieces = ["x", "yy", "\n", "\n\n", '"', ",", "é", "5 6", "\r\n"]
    given = [(str(i), "v" + "".join(rng.choices(pieces, k=rng.randrange(0, 12))), "end") for i in range(120)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerows([("id", "some text", "z"), *given])
    assert sorted(table(spark, tmp_path, "t.csv", out.getvalue().encode(), split), key=lambda r: int(r[0])) == given


def test_defined_cases(spark, tmp_path):
    assert sorted(table(spark, tmp_path, "a.csv", b'\xef\xbb\xbfid,"n\nm"\r\n1,"x\r\ny"\r\n\r\n2,\xff"z\r\n3,"a ""q"""\r\n', 1 << 20)) == [("1", "x\r\ny"), ("2", "�\"z"), ("3", 'a "q"')]
    assert table(spark, tmp_path, "b.csv", b'id,t\n1,"""q"""\n2,a\\b\n', 1 << 20) == [("1", '"q"'), ("2", "a\\b")]
    path = tmp_path / "c.csv"
    path.write_bytes(b'id,name,n\n1,"a\nb",5\n2,"x ""q"" y",6\n3,"z\n"\n4,"too",7,"m\nany"\n')
    assert [tuple(r) for r in readers.load_table(spark, str(path)).orderBy("id").collect()] == [(1, "a\nb", 5), (2, 'x "q" y', 6), (3, "z\n", None)]
    assert readers.load_table(spark, str(path)).dtypes == [("id", "bigint"), ("name", "string"), ("n", "bigint")]


def test_missing_quote_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "LONGEST", 100)
    run = records._cut({("p", 0): False})
    import pyarrow as pa

    lines = ['a,"b', *["some more text"] * 20]
    batch = pa.RecordBatch.from_arrays([pa.array(["p"] * 21), pa.array([0] * 21), pa.array(lines)], ["path", "start", "value"])
    with pytest.raises(ValueError, match="quote is missing"):
        list(run([batch]))
