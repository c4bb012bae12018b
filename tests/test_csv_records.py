"""Large CSV files are read by many tasks with the result of one."""

import random

import pytest

from prepkit.sources import csv_records, io

SCHEMA = "i bigint, s string, d double, t string"


@pytest.fixture
def small_splits(spark, monkeypatch):
    monkeypatch.setattr(io, "SPLIT_BYTES", 0)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    yield lambda size: [spark.conf.set(n, v) for n, v in zip(names, (str(size), "0"))]
    for n, v in before.items():
        spark.conf.set(n, v)


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def both(spark, path, schema=SCHEMA):
    assert csv_records.records(spark, path) is not None
    return rows_of(io.read_table(spark, path, schema=schema)), rows_of(io.read_table(spark, path, schema=schema, multi_line=True))


def text(rng, newline):
    return "".join(rng.choices(["a", "é漢", '""', ",", newline, newline * 2, " ", "x" * 9], k=rng.randint(0, 12)))


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_breaks_quotes_and_commas_at_every_border(spark, tmp_path, small_splits, newline):
    """Files of a few hundred bytes, cut every 7 to 60 bytes, so that borders fall on every kind of character."""
    rng = random.Random(3)
    folder = tmp_path / "t.csv"
    folder.mkdir()
    for k in range(3):
        rows = [f'{i},"{text(rng, newline)}",{rng.choice(["", "1.5"])},{rng.choice(["", "plain", chr(34) * 2, chr(34) + "q" + chr(34)])}' for i in range(12)]
        rows.insert(5, "")
        body = newline.join([f'i,"s{newline}name",d,t', *rows]) + (newline if k else "")
        (folder / f"part{k}.csv").write_bytes(body.encode())
    for size in (7, 60):
        small_splits(size)
        got, want = both(spark, str(folder))
        assert got == want and len(got) == 36


def test_a_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    path = tmp_path / "t.csv"
    path.write_text("i,s,d,t\n" + "".join(f'{i},"line\nbreak {i}",{i}.5,x\n' for i in range(4000)))
    small_splits(8192)
    cut = csv_records._lines(spark, str(path))
    assert cut.rdd.getNumPartitions() >= 10
    got = io.read_table(spark, str(path), schema=SCHEMA)
    assert got.count() == 4000 and got.where("s = concat('line\\nbreak ', i)").count() == 4000


def test_types_are_inferred_from_all_records(spark, tmp_path, small_splits):
    rng = random.Random(5)
    folder = tmp_path / "t.csv"
    folder.mkdir()
    for k in range(2):
        rows = [f'{i},"{text(rng, chr(10))}",{i}{".5" if k and i == 39 else ""},2024-01-0{1 + i % 9} 10:00:00,{"" if i % 3 else "true"},""' for i in range(40)]
        (folder / f"part{k}.csv").write_text("\n".join(["i,text,d,at,b,i", *rows]) + "\n")
    small_splits(300)
    got, want = io.read_table(spark, str(folder)), io.read_table(spark, str(folder), multi_line=True)
    assert got.schema == want.schema and dict(got.dtypes)["d"] == "double" and len(got.columns) == 6
    assert rows_of(got) == rows_of(want) and got.count() == 80
    assert "FileScan csv" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("body", ["a\n1\n  \n2\n", "first,second,third\n", "name\n1\n\n2\n3\n4\n", 'a,b\n1,"x\ny"\n'])
def test_inference_of_odd_files(spark, tmp_path, small_splits, body):
    path = tmp_path / "t.csv"
    path.write_text(body)
    small_splits(3)
    got, want = io.read_table(spark, str(path)), io.read_table(spark, str(path), multi_line=True)
    assert got.schema == want.schema and rows_of(got) == rows_of(want)


@pytest.mark.parametrize(
    "body",
    [
        'i,s,d,t\n1,5" pipe,,x\n2,6" pipe,,y\n',
        'i,s,d,t\n1,a"b"c,,x\n',
        "i,s,d,t\r1,a,,x\r2,b,,y\r",
    ],
)
def test_odd_quotes_and_line_ends_are_left_to_the_reader(spark, tmp_path, small_splits, body):
    path = tmp_path / "t.csv"
    path.write_bytes(body.encode())
    assert csv_records.records(spark, str(path)) is None
    got = io.read_table(spark, str(path), schema=SCHEMA)
    assert rows_of(got) == rows_of(io.read_table(spark, str(path), schema=SCHEMA, multi_line=True))


def test_bad_rows_still_fail(spark, tmp_path, small_splits):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,2\nx,3\n")
    with pytest.raises(Exception):
        io.read_table(spark, str(path), schema="a int, b int").collect()


def test_byte_order_mark(spark, tmp_path, small_splits):
    path = tmp_path / "t.csv"
    path.write_bytes("\ufeffi,s,d,t\n1,a,,x\n".encode())
    got, want = both(spark, str(path))
    assert got == want and len(got) == 1


def test_files_without_rows(spark, tmp_path, small_splits):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("i,s,d,t\n")
    (folder / "b.csv").write_text("")
    (folder / "c.csv").write_text("i,s,d,t\n1,,,\n")
    got, want = both(spark, str(folder))
    assert got == want and len(got) == 1
