"""Queries against their SQL on inputs that the given tables do not have."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__  # noqa: F401  it registers the queries
from clausegrid.functions import text as T
from clausegrid.plans import catalog


@pytest.fixture
def agree(spark, tmp_path):
    """Whether a query and its SQL give the same rows of a table that is made by SQL."""

    def check(name: str, **tables: str) -> list[tuple]:
        con = duckdb.connect()
        for table, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        df = catalog.QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        found = [tuple(r[c] for c in columns) for r in df.collect()]
        assert Counter(found) == Counter(con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.SQL[name]}) q").fetchall())
        return found

    return check


def test_title_case_of_letters_that_widen(agree):
    """A sharp s is not two letters S, which would make captions of short lines."""
    rows = ["a\naß.", "a\nTzß", "a\nTzaß", "ß\nßß", "a\nﬁx", "a\nŉab", "a\nǰẖẗ", "a\nﬆ", "a\nıſa"]
    found = agree("title_case_lines", documents=" UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS doc_id, '{t}' AS text".replace("\n", "' || chr(10) || '") for k, t in enumerate(rows)))
    assert sum(r[0] for r in found) == 2


def test_upper_is_one_for_one(spark):
    chars = [c for c in map(chr, range(32, 0x10000)) if not 0xD800 <= ord(c) < 0xE000]
    df = spark.createDataFrame([(c, f"a{c}ß") for c in chars], "c string, t string")
    got = {r.c: r.u for r in df.select("c", T.upper(df.t).alias("u")).collect()}
    assert all(len(u) == 3 and u[0] == "A" and u[2] == "ẞ" for u in got.values())
    want = dict(duckdb.connect().execute("SELECT chr(CAST(i AS INT)), upper(chr(CAST(i AS INT))) FROM range(32, 65536) r(i) WHERE i NOT BETWEEN 55296 AND 57343").fetchall())
    assert [c for c in T.WIDENED if got[c][1] != want[c]] == []


LINEITEM = "SELECT CAST(k AS BIGINT) AS l_partkey, CAST(s AS BIGINT) AS l_suppkey, 3 AS l_linenumber FROM range(3) a(k), (VALUES (12344), (1234), (59997), (59996), (1234567), (60000000)) b(s)"


def test_extract_refs_of_long_numbers(agree):
    """Articles of five digits and more are not cut to four."""
    assert "12344" in {r[-1] for r in agree("extract_refs", lineitem=LINEITEM)}


def test_ref_citations_of_long_numbers(agree):
    assert "Pasal 12344" in {r[0] for r in agree("ref_citations", lineitem=LINEITEM)}


def test_ref_target_ids_of_long_numbers(agree):
    assert "pasal:12344" in {r[-1] for r in agree("ref_target_ids", lineitem=LINEITEM)}


def test_relocations_verify_few_pairs(spark, monkeypatch):
    """All texts share rare words; only pairs that sizes, places and sketches allow are held against each other."""
    from clausegrid.operators import integrity

    text = lambda k, n: " ".join(["rare", *(f"w{k}x{i}" for i in range(n))])
    gone = [("d", k, text(k, 20 + k)) for k in range(30)]
    cand = [("d", 100 + k, k, text(k, 20 + k) + " new") for k in range(30)] + [("d", 5, 99, text(5, 25)), ("d", 300, 100, text(5, 25))]
    held = []
    monkeypatch.setattr(integrity, "checkpoint", lambda df, real=integrity.checkpoint: held.append(real(df)) or held[-1])
    found = integrity.relocations(spark.createDataFrame(gone, "doc string, gone_id long, text string"), spark.createDataFrame(cand, "doc string, cand_id long, preorder int, text string"), ["doc"])
    assert {r.gone_id: r.cand_id for r in found.collect()} == {k: 300 if k == 5 else 100 + k for k in range(30)}
    assert next(df.count() for df in held if df.columns == ["a", "b"]) <= 40
