"""The registry, and some registered queries next to their SQL twins."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "runway_load_index_enhanced",
    "best_arrival_enhanced",
    "delay_propagation",
    "effective_edges",
    "influence_outgoing",
    "tuner_day",
    "blocks_to_movements",
    "flight_labels",
    "requests",
    "answers_slots",
    "stream_load_index",
]


def test_every_query_has_a_twin():
    queries = {n for n in entry_points.queries() if n not in entry_points.LLM}
    twins = {n for n in entry_points.oracle_sql() if n not in entry_points.LLM}
    assert set(queries) == set(twins)


def test_twins_are_plain_selects():
    con = connect(SF)
    for name, sql in entry_points.oracle_sql().items():
        assert con.sql(f"SELECT * FROM ({sql}) AS q LIMIT 0").columns, name


def test_entry(spark):
    assert entry_points.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", SAMPLE)
def test_twin_agrees(spark, name):
    run, sql = entry_points.queries()[name], entry_points.oracle_sql()[name]
    assert compare(spark, connect(SF), name, run, sql, SF) in ([], ["empty result"])


def test_no_fragile_calls():
    root = Path(entry_points.__file__).parent / "slotflow"
    source = "\n".join(p.read_text() for p in root.rglob("*.py"))
    for banned in (r"localCheckpoint", r"crossJoin", r"\.toPandas\(", r"@F\.udf", r"\.rdd\b"):
        assert not re.search(banned, source), banned
