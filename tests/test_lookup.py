"""Lookups, the command line, and what surrounds a model."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import types as Ty

from clausegrid.__main__ import main
from clausegrid.operators import advisory, usage
from clausegrid.plans import compare, lookup
from clausegrid.streaming import jobs

LINES = ["BAB I", "UMUM", "Pasal 1", "(1) satu", "(2) lihat ayat (1)", "Pasal 2", "menurut Pasal 1 ayat (1)"]


def test_lookups(spark):
    p = spark.createDataFrame([("p", i, t) for i, t in enumerate(LINES)], "pair_id string, idx int, text string")
    found = compare.structure(p)
    nodes, refs = found["nodes"], found["refs"]
    assert [(r.idx, r.node_id) for r in lookup.paragraph(p, nodes, 3, 99).collect()][:4] == [(0, "bab:I"), (1, "bab:I"), (2, "pasal:1"), (3, "pasal:1/ayat:1")]
    assert [(r.node_id, r.depth) for r in lookup.section_tree(nodes).collect()] == [("root", 0), ("bab:I", 1), ("pasal:1", 2), ("pasal:2", 2)]
    assert [r.node_id for r in lookup.descendants(nodes, "pasal:1").collect()] == ["pasal:1/ayat:1", "pasal:1/ayat:2"]
    assert [r.node_id for r in lookup.siblings(nodes, "pasal:1/ayat:2").collect()] == ["pasal:1/ayat:1", "pasal:1/ayat:2"]
    hit = lookup.resolve_reference(p, nodes, "Pasal 1 ayat (2)").first()
    assert (hit.found, hit.node_id, hit.text) == (True, "pasal:1/ayat:2", "(2) lihat ayat (1)")
    miss = lookup.resolve_reference(p, nodes, "Pasal 1 ayat (9)").first()
    assert (miss.found, miss.node_id) == (False, "pasal:1")
    assert [r.idx for r in lookup.references_to(p, refs, "pasal:1/ayat:1").collect()] == [4, 6]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("\n".join(LINES))
    (tmp_path / "b.txt").write_text("\n".join(LINES[:3] + LINES[4:]))
    assert main(["compare", str(tmp_path / "a.txt"), str(tmp_path / "b.txt"), "--json"]) == 2
    assert json.loads(capsys.readouterr().out)["summary"]["critical"] >= 1
    assert main(["inspect", str(tmp_path / "a.txt"), "--refs"]) == 0
    assert "-> pasal:1/ayat:1" in capsys.readouterr().out
    assert main(["inspect", str(tmp_path / "no.txt")]) == 3


def test_rejected_answers_are_asked_again():
    asked = []
    provider = lambda p: asked.append(p) or ("[1]" if len(asked) == 1 else "[2]")
    assert advisory.ask_grounded(provider, "p", lambda a: ["not there"] if a == [1] else []) == [2]
    assert asked[1].endswith("#0: not there")
    assert advisory.missing_tiers({"triage": "k", "analyze": ""}, list(usage.RATES)) == ["adjudicate", "analyze", "recommend"]


def test_answers_that_are_cut_off():
    asked = []
    provider = lambda p, n: asked.append(n) or ('{"a": [1', True) if n < 8 else ('{"a": [1]}', False)
    assert advisory.ask_whole(provider, "p", 4) == {"a": [1]}
    with pytest.raises(ValueError, match="cut off at 6"):
        advisory.ask_whole(provider, "p", 3)
    with pytest.raises(ValueError, match="no JSON"):
        advisory.ask_whole(lambda p, n: ("nothing", False), "p")
    waits, tries = [], iter([OSError(), OSError(), ("[1]", False)])

    def failing(p, n):
        x = next(tries)
        if isinstance(x, Exception):
            raise x
        return x

    assert advisory.ask_whole(failing, "p", wait=waits.append) == [1] and waits == [0.5, 1.0]
    with pytest.raises(TimeoutError):
        advisory.limited(lambda p: time.sleep(1), 0.05)("p")


def test_shape():
    schema = Ty.StructType([Ty.StructField("ids", Ty.ArrayType(Ty.IntegerType())), Ty.StructField("ok", Ty.BooleanType())])
    assert advisory.shape_of(schema) == '{"ids": [number], "ok": boolean}'


def test_inbox(spark, tmp_path):
    (tmp_path / "pair7").mkdir()
    (tmp_path / "pair7" / "prev.txt").write_text("x")
    (tmp_path / "pair7" / "note.txt").write_text("x")
    query = jobs.inbox(spark, str(tmp_path)).writeStream.format("memory").queryName("inbox_rows").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.pair_id, r.side) for r in spark.table("inbox_rows").collect()] == [("pair7", "prev")]


def test_oversized_files_are_errors(spark, tmp_path):
    from clausegrid.sources import files
    from clausegrid.streaming import jobs

    (tmp_path / "pair1").mkdir()
    (tmp_path / "pair1" / "prev.txt").write_text("Pasal 1\nisi")
    (tmp_path / "pair1" / "curr.txt").write_text("x" * 200)
    docs = files.read_paths(spark, f"{tmp_path}/*/*", max_bytes=100)
    paragraphs, errors = files.paragraphs(docs, ["path"])
    assert paragraphs.count() == 2
    assert [(r.path.rsplit("/", 1)[1], r.error) for r in errors.collect()] == [("curr.txt", "the file is too large")]
    query = jobs.inbox(spark, str(tmp_path), max_bytes=100).writeStream.format("memory").queryName("oversized_rows").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.side, r.content is None, r.error is None) for r in spark.table("oversized_rows").collect()} == {("prev", False, True), ("curr", True, False)}
