"""CSV files of all dialects through one scan, with quoted line breaks over splits."""

from __future__ import annotations

import csv
import io
import random
from datetime import datetime

import pytest

from slotflow.sources import delimited, ingest

HEADER = ["Date", "From", "To", "Flight No", "STD", "Gate"]


@pytest.fixture(params=["134217728", "48"], ids=["whole files", "small splits"])
def splits(request, spark):
    names = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield int(request.param)
    for n, v in before.items():
        spark.conf.set(n, v)


def records(spark, path):
    rows = delimited.csv_records(spark, path).orderBy("file", "file_part", "nth").collect()
    out = {}
    for r in rows:
        out.setdefault(r.file.rsplit("/", 1)[-1], []).append(r.cells)
    return out


def test_records_equal_the_csv_module(spark, tmp_path, splits):
    rng = random.Random(4)
    words = ["BOM", "", "a b", 'say "x"', "two\nlines", "two\r\nlines", "x\n\ny\n", '5" pipe', ";,|", "été", '"']
    files = {}
    for i, sep in enumerate([",", ";", "|", "\t"]):
        text = io.StringIO(newline="")
        writer = csv.writer(text, delimiter=sep, lineterminator="\n")
        writer.writerow(HEADER)
        for _ in range(40):
            writer.writerow([rng.choice(words) for _ in HEADER])
        # bare cells may hold quotes, also an odd number of them
        text.write(sep.join(["02/03/2024", '5" x', "a", "b", 'c"', '"d\ne"']) + "\n")
        files[f"f{i}.csv"] = (text.getvalue(), sep)
        (tmp_path / f"f{i}.csv").write_text(text.getvalue(), newline="")
    got = records(spark, str(tmp_path))
    for name, (text, sep) in files.items():
        want = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep)]
        assert [r for r in got[name] if r != [""]] == [r for r in want if r], name


def test_dialects_in_one_folder(spark, tmp_path, splits):
    body = "Date;From;To;Flight No;STD;Gate\n02/03/2024;BOM;DEL;101;10:00;é“x”\n;DEL;BOM;102;11:30;b\n"
    (tmp_path / "a.csv").write_bytes(body.encode("cp1252"))
    (tmp_path / "b.csv").write_bytes(("﻿" + body.replace(";", "|").replace("é“x”", "é")).encode())
    # a blank line, a title with more separators of another kind, then the header
    (tmp_path / "c.csv").write_text('\r\n \r\nPlan, of, all, flights, and, more, days\nFrom;To;Flight No;STD\r\nBOM;DEL;1;10:00\r\n', newline="")
    (tmp_path / "d.csv").write_text('"Flight No","STD\n(local)","From"\n"7","09:00","BOM"\n')
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "f.csv").write_text("one,two\n1,2\n")
    (tmp_path / "g.csv").write_text('From,Flight No,Gate\nBOM,8,"never closed\nDEL,9,x\n')
    rows = delimited.read_csv_files(spark, str(tmp_path)).orderBy("row_id").collect()
    got = [(r.source_file.rsplit("/", 1)[-1], r.origin, r.flight_number, r.sched_dep, r.gate) for r in rows]
    assert got == [
        ("a.csv", "BOM", "101", "10:00", "é“x”"),
        ("a.csv", "DEL", "102", "11:30", "b"),
        ("b.csv", "BOM", "101", "10:00", "é"),
        ("b.csv", "DEL", "102", "11:30", "b"),
        ("c.csv", "BOM", "1", "10:00", None),
        ("d.csv", "BOM", "7", None, None),
        ("f.csv", None, None, None, None),
        ("g.csv", "BOM", "8", None, got[7][4]),
        ("g.csv", "DEL", "9", None, "x"),
    ]
    assert len({r.row_id for r in rows}) == len(rows)


def test_movements_of_a_file(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Date;From;To;Flight No;STD\n02/03/2024;BOM;DEL;101;10:00\n;DEL;BOM;102;11:30\n")
    out = ingest.ingest(spark, str(tmp_path / "s.csv")).orderBy("row_id").collect()
    assert [(r.flight_id, r.sched_dep) for r in out] == [("101", datetime(2024, 3, 2, 10)), ("102", datetime(2024, 3, 2, 11, 30))]
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="no rows"):
        ingest.ingest(spark, str(tmp_path / "empty.csv"))


def test_quoted_breaks_are_read_by_many_tasks(spark, tmp_path, splits):
    lines = ["Flight No,STD,Gate"] + [f'{i},10:00,"g{i}\nlower, part"' for i in range(400)]
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    rows = delimited.read_csv_files(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r.flight_number for r in rows] == [str(i) for i in range(400)] * 2
    assert [r.gate for r in rows] == [f"g{i}\nlower, part" for i in range(400)] * 2
    tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    assert (tasks > 100) == (splits == 48)
    # one kind of scan for the rows, whatever the dialects
    plan = delimited.read_csv_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Scan csv" not in plan
