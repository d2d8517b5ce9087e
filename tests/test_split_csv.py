"""CSV files with line breaks in quotes: read from splits as by one task."""

import csv
import glob
import random

import pytest
from pyspark.sql import functions as F

from tablegauge.sources import csv_files, split_csv
from tablegauge.sources.csv_files import read_csv


@pytest.fixture
def small_blocks(spark):
    """Files are split every few hundred bytes."""
    changed = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def cell(rng, sep, broken):
    parts = ["word", "ünï", '""', sep, " ", "1", "NA"] + (["\n", "\r\n", "\n\n"] if broken else [])
    text = "".join(rng.choice(parts) for _ in range(rng.randrange(6)))
    return f'"{text}"' if any(c in text for c in '"\r\n' + sep) or rng.random() < 0.2 else text


def write(path, rows, sep, end):
    path.write_bytes((end.join(sep.join(r) for r in rows) + end).encode())
    return str(path)


def one_task(spark, path, sep):
    reader = spark.read.options(sep=sep, escape='"', nullValue="", header=True, multiLine=True)
    return sorted(map(tuple, csv_files.blank_to_null(reader.csv(path)).collect()), key=str)


def as_written(path):
    """The cells as Python's own reader finds them, line ends within quotes untouched."""
    rows = []
    for name in sorted(glob.glob(f"{path}/*.csv")):
        with open(name, newline="", encoding="utf-8") as file:
            found = csv.reader(file, delimiter=as_written.sep)
            next(found)
            rows += [tuple(None if c in csv_files.NA_TOKENS else c for c in r) for r in found]
    return sorted(rows, key=str)


def with_line_feeds(rows):
    """Spark's reader turns the line ends of the file into line feeds within quotes, too."""
    return sorted((tuple(c and c.replace("\r\n", "\n") for c in r) for r in rows), key=str)


def split(spark, path):
    return sorted(map(tuple, read_csv(spark, path, typed=False).collect()), key=str)


@pytest.mark.parametrize(("sep", "end", "share"), [(",", "\n", 0.3), (";", "\r\n", 0.05), ("|", "\n", 0.0), ("\t", "\r\n", 0.9)])
def test_same_as_one_task(spark, tmp_path, small_blocks, sep, end, share):
    rng = random.Random(share)
    (tmp_path / "files").mkdir()
    for i in range(3):
        rows = [["id", '"a ""b"""', "c"]] + [[str(j), cell(rng, sep, rng.random() < share), cell(rng, sep, rng.random() < share)] for j in range(150)]
        write(tmp_path / "files" / f"{i}.csv", rows, sep, end)
    path = str(tmp_path / "files")
    lines = split_csv.text_lines(spark, path, "UTF-8", "\n")
    states = split_csv.block_states(lines, split_csv.header_line(lines))
    assert states.groupBy("file").count().where("count > 5").count() == 3
    assert not split_csv.is_misquoted(lines, states, sep)
    assert states.where("is_plain").count() == 0 if share > 0.5 else states.where("is_plain").count() > 0
    got = split(spark, path)
    as_written.sep = sep
    assert got == as_written(path)
    assert with_line_feeds(got) == with_line_feeds(one_task(spark, path, sep))


def test_a_record_over_many_blocks(spark, tmp_path, small_blocks):
    long = "\n".join(f"line {i}" for i in range(400))
    rows = [["a", "b"], ["1", f'"{long}"'], ["2", "x"], ["3", '"y\nz"'], ["4", "w"]] + [[str(i), "plain"] for i in range(5, 200)]
    path = write(tmp_path / "t.csv", rows, ",", "\n")
    got = {r.a: r.b for r in read_csv(spark, path).collect()}
    assert len(got) == 199 and got[1] == long and got[3] == "y\nz"


def test_headers(spark, tmp_path, small_blocks):
    """A header over two lines, data like the header, other headers in other files, empty lines in front."""
    (tmp_path / "h").mkdir()
    write(tmp_path / "h" / "1.csv", [['"a\nb"', "c"], ["1", "2"], ['"a\nb"', "c"]], ",", "\n")
    write(tmp_path / "h" / "2.csv", [['"a\nb"', "c"], ["5", '"6\n7"']], ",", "\n")
    assert split(spark, str(tmp_path / "h")) == one_task(spark, str(tmp_path / "h"), ",")
    (tmp_path / "g").mkdir()
    write(tmp_path / "g" / "1.csv", [["a", "b"], ["1", "2"], ["a", "b"], ["3", "4"]], ",", "\n")
    write(tmp_path / "g" / "2.csv", [["x", "y"], ["a", "b"]], ",", "\n")
    write(tmp_path / "g" / "3.csv", [["a", "b"]], ",", "\n")
    got = split(spark, str(tmp_path / "g"))
    assert got == one_task(spark, str(tmp_path / "g"), ",") and len(got) == 4
    (tmp_path / "e.csv").write_text('\n\na,b\n\n1,"2\n\n3"\n\n4,5\n')
    assert split(spark, str(tmp_path / "e.csv")) == [("1", "2\n\n3"), ("4", "5")]


@pytest.mark.parametrize("text", ['a,b\n5" pipe,x\n6" pipe,y\n', 'a,b\n1,"x\n2,y\n', 'a,b\nx"y,1\n2,"p\nq"\n', 'a,b\n5",x\n6,z\n7",y\n'])
def test_misquoted_files_are_read_by_one_task(spark, tmp_path, text):
    path = tmp_path / "m.csv"
    path.write_text(text)
    lines = split_csv.text_lines(spark, str(path), "UTF-8", "\n")
    assert split_csv.is_misquoted(lines, split_csv.block_states(lines, "a,b"), ",")
    assert split(spark, str(path)) == one_task(spark, str(path), ",")


def test_carriage_returns_and_latin(spark, tmp_path, small_blocks):
    (tmp_path / "mac.csv").write_bytes(b'a,b\r1,2\r3,"4, 5"\r')
    assert split(spark, str(tmp_path / "mac.csv")) == [("1", "2"), ("3", "4, 5")]
    (tmp_path / "l.csv").write_bytes('a;b\n1;"Málaga\n5 €"\n2;x\n'.encode("cp1252") * 1)
    assert split(spark, str(tmp_path / "l.csv")) == [("1", "Málaga\n5 €"), ("2", "x")]


def test_several_tasks_read_one_file(spark, tmp_path, small_blocks):
    rows = [["a", "b"]] + [[str(i), '"x\ny"' if i % 50 == 0 else "z"] for i in range(500)]
    path = write(tmp_path / "t.csv", rows, ",", "\n")
    df = read_csv(spark, path, typed=False)
    assert df.count() == 500 and df.where(F.col("b") == "x\ny").count() == 10
    lines = split_csv.text_lines(spark, path, "UTF-8", "\n")
    assert lines.select(F.spark_partition_id()).distinct().count() > 5


def test_long_lines_in_quotes(spark, tmp_path):
    """Lines of 300,000 characters that open, close or stay within quotes; F1: they overflowed the stack."""
    long = 'x "" y, ' * 40_000
    text = f'a,b\n1,"{long}\n{long}\n{long}"\n2,"{long}"\n'
    path = tmp_path / "long.csv"
    path.write_text(text)
    lines = split_csv.text_lines(spark, str(path), "UTF-8", "\n")
    assert not split_csv.is_misquoted(lines, split_csv.block_states(lines, "a,b"), ",")
    plain = long.replace('""', '"')
    got = {r.a: r.b for r in read_csv(spark, str(path)).collect()}
    assert got == {1: f"{plain}\n{plain}\n{plain}", 2: plain}
    (tmp_path / "wrong.csv").write_text(f'a,b\n1,"{long}\n2,x\n3,{long} y"\n4,x"\n')
    lines = split_csv.text_lines(spark, str(tmp_path / "wrong.csv"), "UTF-8", "\n")
    assert split_csv.is_misquoted(lines, split_csv.block_states(lines, "a,b"), ",")
