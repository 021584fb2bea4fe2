"""License notices that are wrapped over several lines."""

import textwrap

import pytest

from tidewheel.llm import licenses

LONG = [k for k, (_, t) in enumerate(licenses.TEMPLATES) if len(licenses.split_words(t)) >= 12]


@pytest.mark.parametrize(("width", "prefix"), [(72, ""), (78, " * "), (60, "# ")])
def test_wrapped_notices(spark, width, prefix):
    wrap = lambda t: "\n".join(prefix + x for x in textwrap.wrap(t, width))
    docs = spark.createDataFrame([(k, "Some words before\n\n" + wrap("Copyright the authors. " + licenses.TEMPLATES[k][1]) + "\n\nand after") for k in LONG], "doc_id long, text string")
    got = {(r.doc_id, r.template): r for r in licenses.wrapped(docs).collect()}
    assert all((k, k) in got for k in LONG)
    assert all(r.containment >= licenses.THRESHOLD for r in got.values())


def test_runs_are_the_shortest_and_rows_stay_apart(spark):
    text = "nothing\nLicensed under\nthe MIT License\nnothing\nLicensed under the MIT License\nReleased"
    rows = [(1, text), (1, "Licensed under"), (1, "the MIT License"), (2, None), (3, ""), (None, "All rights reserved")]
    got = licenses.wrapped(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    k = licenses.TEMPLATES.index(("MIT", "Licensed under the MIT License"))
    assert sorted((r.doc_id, r.block, r.lines) for r in got if r.template == k) == [(1, 1, 2), (1, 4, 1)]
    assert [(r.block, r.lines, r.license) for r in got if r.doc_id is None] == [(0, 1, "Proprietary")]


def test_lines_that_the_scan_finds_are_runs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    runs = {(r.doc_id, r.block, r.template) for r in licenses.wrapped(docs).filter("lines = 1").collect()}
    assert {(r.doc_id, r.block, r.template) for r in licenses.scan(docs).collect()} == runs
