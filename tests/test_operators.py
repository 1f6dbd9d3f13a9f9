"""Trees, diffs, plans, gates and sources on small inputs."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from clausegrid.operators import advisory, diff, grounding, integrity, jobs, numbering, parallel, tree, usage
from clausegrid.sources import files, sinks
from clausegrid.streaming import trace

KEYS = ["doc"]


def paragraphs(spark, *docs):
    rows = [(f"d{k}", i, t) for k, lines in enumerate(docs) for i, t in enumerate(lines)]
    return spark.createDataFrame(rows, "doc string, idx int, text string")


def ids(spark, *lines):
    return [r.node_id for r in tree.build(paragraphs(spark, lines), KEYS).orderBy("preorder").collect()]


def test_tree_nests_lists(spark):
    assert ids(spark, "BAB I", "KETENTUAN UMUM", "Pasal 1", "(1) satu", "a. x", "b. y", "c. z", "(2) dua", "Pasal 2") == [
        "root", "bab:I", "pasal:1", "pasal:1/ayat:1", "pasal:1/ayat:1/huruf:a", "pasal:1/ayat:1/huruf:b", "pasal:1/ayat:1/huruf:c", "pasal:1/ayat:2", "pasal:2",
    ]


def test_tree_keeps_duplicates_and_rejects_companies(spark):
    assert ids(spark, "Pasal 1", "PT. ABC", "Pasal 1", "CV. XYZ") == ["root", "pasal:1", "pasal:1#2"]


def test_tree_learns_headings(spark):
    assert ids(spark, "ARTIKEL 1", "isi", "ARTIKEL 2", "isi", "ARTIKEL 3") == ["root", "article:1", "article:2", "article:3"]


def test_tree_title_and_ranges(spark):
    rows = {r.node_id: r for r in tree.build(paragraphs(spark, ["BAB I", "KETENTUAN UMUM", "Pasal 1", "isi", "Pasal 2"]), KEYS).collect()}
    assert rows["bab:I"].title == "KETENTUAN UMUM"
    assert (rows["pasal:1"].start, rows["pasal:1"].end, rows["pasal:2"].end, rows["bab:I"].end) == (2, 3, 4, 4)


def test_empty_documents(spark):
    none = paragraphs(spark, ["x"]).limit(0)
    assert tree.build(none, KEYS).count() == 0
    assert diff.paragraph_changes(none, none, KEYS).count() == 0


def test_references_take_their_article(spark):
    p = paragraphs(spark, ["Pasal 3", "(1) lihat ayat (2)", "(2) x"])
    refs = tree.references(p, tree.build(p, KEYS), KEYS).collect()
    assert [(r.target_id, r.context) for r in refs] == [("pasal:3/ayat:2", "Pasal 3 ayat (1)")]


def test_diff_is_minimal_and_lossless():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 10))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        runs = diff.edits(a, b)
        assert sum(j - i for op, i, j in runs if op != "=") == len(a) + len(b) - 2 * table[-1][-1]
        assert [x for op, i, j in runs if op in "=-" for x in a[i:j]] == a


def test_highlight():
    assert diff.highlight("30 hari", "60 hari") == ("<b>30</b> hari", "<b>60</b> hari")
    assert diff.highlight("", "<x>") == ("", "<b>&lt;x&gt;</b>")


def test_compare_drops_blank_changes():
    assert diff.compare(["a", "", "b"], ["a", "b"]) == []
    assert [c[1] for c in diff.compare(["a", "b"], ["a", "c", "d"])] == ["modified"]


def sequence(spark, *ordinals):
    return spark.createDataFrame([("s", i, n, "DIGIT", "DOT") for i, n in enumerate(ordinals)], "key string, pos int, ordinal int, kind string, form string")


@pytest.mark.parametrize(
    ("ordinals", "categories"),
    [
        ((1, 2, 3), []), ((1, 2, 2), ["duplicate"]), ((2, 3), ["bad_start"]), ((1, 3), ["gap"]), ((1, 3, 2), ["gap", "out_of_order"]), ((5,), []), ((2, 2, 4, 8, 6), ["bad_start", "duplicate", "gap", "gap", "out_of_order"]),
    ],
)
def test_numbering(spark, ordinals, categories):
    found = sorted(r.category.removeprefix("numbering_") for r in numbering.findings(sequence(spark, *ordinals), ["key"]).collect())
    assert found == categories


def test_plan_leaves_no_defect(spark):
    planned = numbering.plan(sequence(spark, 2, 2, 4, 8, 6), ["key"])
    assert [r.new_text for r in planned.orderBy("pos").collect()] == ["1.", None, "3.", "4.", "5."]
    assert numbering.findings(numbering.apply_plan(planned).select("key", "pos", "ordinal", "kind", "form"), ["key"]).count() == 0


def test_parallel(spark):
    rows = [("d", k, i, n) for i, (k, n) in enumerate([("a", 1), ("b", 1), ("a", 2), ("b", 3), ("a", 3), ("b", 3), ("a", 4)])]
    h = spark.createDataFrame(rows, "doc string, keyword string, pos int, ordinal int")
    assert sorted((r.pos, r.problem) for r in parallel.mismatches(h, KEYS).collect()) == [(3, "position"), (6, "count")]
    assert parallel.describe(h, KEYS).first().counts == '"a" punya 4 dan "b" punya 3'


def test_relocation(spark):
    gone = spark.createDataFrame([("d", "pasal:3", "satu dua tiga empat lima enam"), ("d", "pasal:9", "terlalu pendek")], "doc string, gone_id string, text string")
    cand = spark.createDataFrame([("d", "pasal:4", 1, "satu dua tiga empat lima enam tujuh"), ("d", "pasal:5", 2, "satu dua tiga empat lima enam"), ("d", "pasal:3", 0, "satu dua tiga empat lima enam")], "doc string, cand_id string, preorder int, text string")
    assert [(r.gone_id, r.cand_id, r.score) for r in integrity.relocations(gone, cand, KEYS).collect()] == [("pasal:3", "pasal:5", 1.0)]


def test_repoint(spark):
    assert spark.range(1).select(integrity.repoint(F.lit("Pasal 3 ayat (3)"), F.lit("3"), F.lit("4"))).first()[0] == "Pasal 4 ayat (3)"


def test_grounding(spark):
    p = paragraphs(spark, ["Jangka waktu 30 hari.", "x"])
    rows = [("d0", 0, "replacement", 0, "30 hari", "60 hari"), ("d0", 1, "replacement", 0, "jangka  WAKTU", "y"), ("d0", 2, "replacement", 0, "40 hari", "y"), ("d0", 3, "replacement", None, "x", "y"), ("d0", 4, "replacement", 7, "x", "y"), ("d0", 5, "replacement", 1, " ", "y"), ("d0", 6, "replacement", 1, "x", "x"), ("d0", 7, "manual_review", None, None, None)]
    a = spark.createDataFrame(rows, "doc string, n int, type string, paragraph_index int, old string, new string")
    got = [r.reason for r in grounding.ground_actions(a, p, KEYS).orderBy("n").collect()]
    assert got == [None, None, "not_found", "no_index", "out_of_range", "empty_old", "no_change", None]


def test_salvage_and_ask():
    assert advisory.salvage_json('ok:\n```json\n{"a": [1, "}"]}\n```') == {"a": [1, "}"]}
    assert advisory.salvage_json('So {"a": "\\"}"} done') == {"a": '"}'}
    answers, waits = iter(["nothing", "still nothing", "[1]"]), []
    assert advisory.ask(lambda _: next(answers), "p", wait=waits.append) == [1]
    assert waits == [0.5, 1.0]
    with pytest.raises(ValueError):
        advisory.salvage_json("none")


def test_usage(spark):
    calls = spark.createDataFrame([("a", 5), ("a", 6), ("b", 1)], "node string, tokens int")
    assert {r.node: (r.calls, r.tokens) for r in usage.rollup(calls, ["tokens"]).collect()} == {"a": (2, 11), "b": (1, 1), "total": (3, 12)}


def test_trace_batch_and_stream_agree(spark):
    rows = [(1, 1, "triage", "thought", "a"), (1, 2, "triage", "thought", "b"), (1, 3, "triage", "note", "n"), (1, 4, "triage", "note", "m"), (1, 5, "analyze", "thought", "c"), (1, 6, "triage", "thought", "d")]
    batch = jobs.coalesce_stream(spark.createDataFrame(rows, "job long, n long, node string, kind string, text string"), "job", "n").orderBy("seq").collect()
    state, last = None, {}
    for _, n, node, kind, text in rows:
        changed, state = trace.extend(state, [(n, node, kind, text)])
        last |= {e[0]: e[1:4] for e in changed}
    assert [(r.seq, r.node, r.kind, r.text) for r in batch] == [(s, *e) for s, e in sorted(last.items())]


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx():
    p = "<w:p><w:pPr><w:pStyle w:val='H1'/><w:numPr><w:ilvl w:val='1'/><w:numId w:val='7'/></w:numPr></w:pPr><w:r><w:t>a</w:t></w:r><w:del><w:r><w:delText>x</w:delText><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:t>b</w:t></w:r></w:ins><w:r><w:tab/><w:t>c</w:t><w:br/><w:t>d</w:t></w:r></w:p>"
    cell = lambda x: f"<w:tc>{x}</w:tc>"
    text = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    nested = f"<w:tbl><w:tr>{cell(text('in'))}{cell('<w:tbl><w:tr>' + cell(text('inner')) + '</w:tr></w:tbl>' + text('after'))}</w:tr></w:tbl>"
    found = files.docx_paragraphs(docx(p + nested + text("last")))
    assert (found[0]["raw"], found[0]["style"], found[0]["list_id"], found[0]["list_lvl"]) == ("ab\tc d", "H1", 7, 1)
    assert [(f["raw"], f["tbl"], f["tbl_row"], f["tbl_col"]) for f in found[1:]] == [("in", 1, 1, 1), ("inner", 2, 1, 1), ("after", 1, 1, 2), ("last", 0, 0, 0)]
    for bad in (b"no zip", docx("")[:40]):
        with pytest.raises(ValueError):
            files.docx_paragraphs(bad)


def test_paragraphs_of_mixed_files(spark):
    rows = [("t", "a.txt", b"x\r\n  y  \n\n\n"), ("w", "b.DOCX", docx("<w:p><w:r><w:t>z</w:t></w:r></w:p>")), ("e", "c.docx", b"?"), ("u", "d.xls", b"?"), ("n", "f.md", None)]
    good, bad = files.paragraphs(spark.createDataFrame(rows, "doc string, path string, content binary"), KEYS)
    assert sorted((r.doc, r.idx, r.text) for r in good.collect()) == [("t", 0, "x"), ("t", 1, "y"), ("w", 0, "z")]
    assert sorted(r.doc for r in bad.collect()) == ["e", "u"]


def test_sinks(spark):
    nodes = tree.build(paragraphs(spark, ["Pasal 1", "(1) x"]), KEYS)
    assert [r.line for r in sinks.tree_lines(nodes, KEYS).orderBy("preorder").collect()] == ["      pasal 1 [0-1]", "        ayat 1 [1-1]"]
    assert sinks.json_lines(spark.createDataFrame([("d", 1)], "doc string, n int"), KEYS).first().json == '{"n":1}'
