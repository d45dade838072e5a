"""CSV files with line breaks in cells, at any split size, against the csv module."""

import csv
import random

import pytest

from leadloom.sources.csv_import import read_import_csv

CELLS = ["", "plain", "a,b", 'say "hi"', "two\nlines", "three\n\nlines\n", '"', '""', "0123456789", " padded ", "é中",
         'x\n"y",z\n', "crlf\r\ninside", "tail\r", ",", "\n"]


def save(path, rows, newline="\r\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=newline).writerows(rows)


def expected(path):
    with open(path, newline="", encoding="utf-8") as f:
        return [tuple(c or None for c in r) for r in list(csv.reader(f))[1:] if r]


def read(spark, path, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = read_import_csv(spark, str(path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len({r["ord"] for r in rows}) == len(rows)
    return [tuple(r)[:-1] for r in sorted(rows, key=lambda r: r["ord"])]


@pytest.mark.parametrize("size, newline", [("512", "\n"), ("1k", "\r\n"), ("64k", "\n"), ("1m", "\r\n")])
def test_equals_the_csv_module(spark, tmp_path, size, newline):
    r = random.Random(size)
    rows = [[r.choice(CELLS) for _ in range(3)] for _ in range(600)] + [["long", "line\n" * 400, "end"]]
    rows = [x for x in rows if any(x)]
    save(tmp_path / "a.csv", [["Company", "Phone", "Notes"], *rows], newline)
    got, want = read(spark, tmp_path / "a.csv", size), expected(tmp_path / "a.csv")
    norm = lambda v: v and v.replace("\r\n", "\n").replace("\r", "\n")  # noqa: E731  (line ends inside cells are one kind)
    assert [tuple(map(norm, x)) for x in got] == [tuple(map(norm, x)) for x in want]


def test_quotes_inside_bare_cells_and_open_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Company,Phone\n5" pipe,1\n"x, y",2\nlast,"never\nclosed\nat all')
    assert read(spark, tmp_path / "a.csv", "1m") == expected(tmp_path / "a.csv")


def test_several_files_in_one_task(spark, tmp_path):
    want = []
    for k in range(4):
        rows = [[f"f{k}r{i}", "a\nb" if i % 2 else "c"] for i in range(5)]
        save(tmp_path / f"{k}.csv", [["Company\nname", "Notes"], *rows])
        want += [tuple(x) for x in rows]
    assert read(spark, tmp_path, "1m") == want


def test_headings(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿"Two\nlines",,A,a\n1,2,3,4\n\n5,6,7\n', encoding="utf-8")
    df = read_import_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["Two\nlines", "_c1", "A2", "a3", "ord"]
    assert sorted(tuple(r)[:-1] for r in df.collect()) == [("1", "2", "3", "4"), ("5", "6", "7", None)]
