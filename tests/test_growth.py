"""What the larger tables must not multiply: parsing, header words and the points of sliding sums."""

from __future__ import annotations

from datetime import datetime, timedelta

from slotflow.operators import influence
from slotflow.sources import columns, delimited, tables
from tests.test_goldens import frame


def plan(df):
    return df._jdf.queryExecution().toString()


def test_csv_text_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text('From,To,STD\nBOM,"D\nEL",06:00\n\nBOM,MAA,07:00\n')
    out = delimited.read_csv_files(spark, str(tmp_path))
    assert "_metadata" not in plan(out)  # no scan of the files is left
    assert [tuple(r) for r in out.orderBy("row_id").select("origin", "destination", "sched_dep").collect()] == [("BOM", "D\nEL", "06:00"), ("BOM", "MAA", "07:00")]


def test_lines_without_header_words_are_not_split(spark):
    texts = [(None,), ("",), ("BOM;DEL;06:00",), ('"Flight No";S T D;x',), ("To_",), ("FROM|to",)]
    held = spark.createDataFrame(texts, "v string").select(columns.holds_header_word(columns.F.col("v")).alias("h")).collect()
    assert [bool(r.h) for r in held] == [False, False, False, True, True, True]


def test_blocks_flag_headers_and_name_words_once(spark, monkeypatch):
    calls = []
    plain = columns.normalise_token
    monkeypatch.setattr(columns, "normalise_token", lambda c: (calls.append(1), plain(c))[1])
    sheet = [["From", "To", "to", "STD"], ["BOM", "DEL", "x", "06:00"], [None, "MAA", "y", None]]
    cells = spark.createDataFrame([("b", None, i, c) for i, c in enumerate(sheet)], "source_file string, sheet string, row_idx long, cells array<string>")
    assert "regexp" not in plan(tables.locate_blocks(cells)).lower()
    rows = tables.read_blocks(cells).orderBy("row_id").select("origin", "destination", "sched_dep").collect()
    assert len(calls) == 1
    assert [tuple(r) for r in rows] == [("BOM", "DEL", "06:00"), (None, "MAA", None)]


def test_sliding_sums_run_over_instants_not_movements(spark, monkeypatch):
    seen = []
    parts = influence.band_parts
    monkeypatch.setattr(influence, "band_parts", lambda points, *rest: (seen.append(points.count()), parts(points, *rest))[1])
    start = datetime(2024, 3, 2, 5, 0)
    rows = [{"flight_id": f"F{i}", "carrier": "AI", "sched_dep": start + timedelta(hours=3 * (i % 3)), "dep_delay_min": 1.0, "origin": "BOM"} for i in range(30)]
    reach = {r.row_id: r.reach for r in influence.propagate(frame(spark, rows), 2, 0.5, "outgoing").collect()}
    assert seen == [3, 3] and len(reach) == 30
