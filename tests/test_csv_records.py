"""The parallel CSV scan against the built-in one-task reader."""

import csv
import io
import os
import random

import pytest

from memaudit.sources import csv_records, readers

CELLS = ["", "a", "two words", "quo\"te", "line\nfeed", "car\r\nriage", "com,ma", "\n", "\"", "\"\"", "é ü", "x" * 300, "a\n\n\nb", " lead", "\",\n\"", "NA"]


def write(path, rows, header=("id", "Note, free", "c"), end="\r\n", last=True):
    buf = io.StringIO()
    w = csv.writer(buf, lineterminator=end)
    w.writerow(header)
    w.writerows(rows)
    text = buf.getvalue()
    with open(path, "wb") as f:
        f.write((text if last else text.rstrip("\r\n")).encode("cp1252"))


@pytest.fixture()
def small_splits(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield use
    for k, v in keep.items():
        spark.conf.set(k, v)


def plain(spark, path):
    return spark.read.options(header=True, multiLine=True, escape='"', encoding="ISO-8859-1").csv(path)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [16, 61, 1000, 1 << 20])
def test_equals_the_multiline_reader(spark, small_splits, tmpdir_path, size, end):
    rng = random.Random(size)
    path = os.path.join(tmpdir_path, "one.csv")
    write(path, [(i, rng.choice(CELLS), rng.choice(CELLS)) for i in range(120)], end=end, last=size != 61)
    small_splits(size)
    got = csv_records.read_csv(spark, path, "ISO-8859-1", row="row")
    want = [tuple(r) for r in plain(spark, path).collect()]
    rows = sorted(map(tuple, got.collect()), key=lambda r: r[-1])
    assert [r[:-1] for r in rows] == want and [r[-1] for r in rows] == list(range(120))
    assert got.columns == ["id", "Note, free", "c", "row"]


def test_one_file_is_read_by_many_tasks(spark, small_splits, tmpdir_path):
    path = os.path.join(tmpdir_path, "one.csv")
    write(path, [(i, "line\n" * 5, i) for i in range(300)])
    small_splits(1000)
    lines = csv_records._lines(spark, path, "ISO-8859-1")
    assert lines.rdd.getNumPartitions() > 8 and plain(spark, path).rdd.getNumPartitions() == 1
    assert csv_records.read_csv(spark, path).count() == 300


def test_ids_follow_the_files_however_they_are_split(spark, small_splits, tmpdir_path):
    rng, want = random.Random(2), []
    for name in ("b.csv", "a.csv", "c.csv"):
        rows = [(f"{name}{i}", rng.choice(CELLS), "z") for i in range(rng.randint(1, 40))]
        write(os.path.join(tmpdir_path, name), rows)
        want.append((name, [r[0] for r in rows]))
    order = [x for _, ids in sorted(want) for x in ids]
    for size in (32, 500, 1 << 20):
        small_splits(size)
        got = readers.read_cohort_csv(spark, tmpdir_path, row_ids="patient_id").select("patient_id", "id").collect()
        assert sorted((int(p[4:]), i) for p, i in got) == list(enumerate(order))


def test_odd_files(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "odd.csv")
    for body in (b"id,a\n", b"id,a", b"id,a\n\n\n1,2\n\n\"\n\n\",3\n", b"id,a\n1\n1,2,3\n,\n", "id,a\n€\x81,\"“q”\"\n".encode("utf-8")):
        with open(path, "wb") as f:
            f.write(body)
        want = [tuple(r) for r in plain(spark, path).collect()]
        assert sorted(map(str, (tuple(r) for r in csv_records.read_csv(spark, path, "ISO-8859-1").collect()))) == sorted(map(str, want)), body
