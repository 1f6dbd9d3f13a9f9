"""Whole comparisons, against results that were worked out by hand."""

from __future__ import annotations

from clausegrid.plans import compare

PREV = ["BAB I", "KETENTUAN UMUM", "Pasal 1", "(1) Jangka waktu 30 hari.", "(2) Para pihak sepakat.", "a. satu hal;", "b. hal kedua;", "c. hal ketiga.", "Pasal 2", "Pembayaran dilakukan menurut Pasal 3 setiap bulan.", "Pasal 3", "Denda keterlambatan sebesar satu persen per hari kalender.", "Pasal 4", "Penutup perjanjian ini."]
CURR = ["BAB I", "KETENTUAN UMUM", "Pasal 1", "(1) Jangka waktu 60 hari.", "(2) Para pihak sepakat.", "a. satu hal;", "c. hal ketiga.", "Pasal 2", "Pembayaran dilakukan menurut Pasal 3 setiap bulan.", "Pasal 4", "Penutup perjanjian ini."]
MOVED = ["Pasal 1", "Lihat Pasal 2.", "Pasal 3", "Denda keterlambatan sebesar satu persen per hari kalender berjalan."]
BEFORE = ["Pasal 1", "Lihat Pasal 2.", "Pasal 2", "Denda keterlambatan sebesar satu persen per hari kalender berjalan."]


def test_comparisons(spark):
    pairs = [("cut", PREV, CURR), ("moved", BEFORE, MOVED), ("same", PREV, PREV)]
    side = lambda k: spark.createDataFrame([(p[0], i, t) for p in pairs for i, t in enumerate(p[k])], "pair_id string, idx int, text string")
    out = compare.compare(side(1), side(2))
    found = {}
    for r in out["findings"].orderBy("pair_id", "place").collect():
        found.setdefault(r.pair_id, []).append((r.category, r.severity, r.para_index, r.action, r.old, r.new))
    assert found["cut"] == [
        ("broken_reference", "critical", 8, "manual_review", "Pasal 3", None),
        ("numbering_gap", "major", 6, "renumber", "c.", "b."),
        ("numbering_gap", "major", 9, "renumber", "4", "3"),
        ("section_removed", "major", 10, "", None, None),
    ]
    assert ("shifted_reference", "critical", 1, "reference_update", "Pasal 2", "Pasal 3") in found["moved"]
    assert ("section_removed", "minor", 2, "", None, None) in found["moved"]
    assert "same" not in found
    summary = {r.pair_id: r for r in out["summary"].collect()}
    assert (summary["cut"].prev_articles, summary["cut"].curr_articles, summary["cut"].exit_code) == (4, 3, 2)
    assert (summary["same"].total, summary["same"].verified, summary["same"].exit_code) == (0, 0, 0)
    proof = {(r.pair_id, r.category, r.para_index): r.evidence for r in out["findings"].collect()}
    assert proof["cut", "broken_reference", 8] == ["[8] " + CURR[8]]
    assert proof["cut", "numbering_gap", 6] == ["[5] huruf a", "[6] huruf c"]
    assert proof["cut", "section_removed", 10] is None
    assert out["plan_warnings"].count() == 0
    assert {r.title for r in out["changes"].where("pair_id = 'cut'").collect()} == {"Teks diubah pada Pasal 1 ayat (1)", 'Teks dihapus pada Pasal 1 ayat (2) huruf b: "b. hal kedua;"', 'Teks dihapus pada Pasal 3: "Pasal 3 Denda keterlambatan sebesar satu persen…"'}


def test_single_documents(spark):
    lines = ["BAB I", "UMUM", "Pasal 1", "(1) " + "x" * 80 + " menurut Pasal 9 " + "y" * 80, "(2) lihat Pasal 1 ayat (1) dan Pasal 1 ayat (7)."]
    out = compare.inspect(spark.createDataFrame([("p", i, t) for i, t in enumerate(lines)], "pair_id string, idx int, text string"))
    found = [(r.severity, r.para_index, r.message, r.evidence) for r in out["findings"].orderBy("place").collect()]
    at = lines[3].index("Pasal 9")
    assert found == [
        ("major", 3, "Referensi ke Pasal 9 tidak dapat ditemukan dalam dokumen", ["[3] ..." + lines[3][at - 60 : at + 67] + "..."]),
        ("major", 4, "Referensi ke Pasal 1 ayat (7) tidak dapat ditemukan dalam dokumen", ["[4] " + lines[4]]),
    ]
    assert {r.node_id: r.full_path for r in out["nodes"].collect()}["pasal:1/ayat:2"] == "BAB I Pasal 1 ayat (2)"
