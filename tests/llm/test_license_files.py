"""Which files a directory takes its licence from, denied licences and SPDX expressions."""

import duckdb

from quayside.llm import licenses, queries

NOTICE = licenses.PARTS["Apache-2.0"][1]


def test_a_header_speaks_for_its_own_file(spark):
    rows = [
        (1, "g/h.c", "SPDX-License-Identifier: MIT\nint x;"), (2, "g/i.c", "int y;\nint z;"), (3, "g/tag", "SPDX-License-Identifier: MIT"),
        (4, "k/code.c", f"{NOTICE}\nint a;\nint b;\nwhile (a)\nb++;"), (5, "k/b.c", "int b;"), (6, "n/NOTES", NOTICE), (7, "n/deep/c.c", "int c;"), (8, "o/LICENSE", "SPDX-License-Identifier: ISC\nmore text\nmore text"), (9, "o/d.c", "int d;"),
    ]
    got = {r.file_id: (r.license, r.licence_file, r.licensed_by) for r in licenses.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert got[1] == ("MIT", False, None) and got[2] == (None, False, None) and got[3] == ("MIT", False, None)
    assert got[4] == ("Apache-2.0", False, None) and got[5] == (None, False, None)
    assert got[6] == ("Apache-2.0", True, None) and got[7] == ("Apache-2.0", False, "n")
    assert got[8] == ("ISC", True, None) and got[9] == ("ISC", False, "o")


def scanned(spark, rows):
    frame = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(rows)], "file_id long, path string, text string")
    return {r.path: r for r in licenses.scan(frame).collect()}


def test_a_denied_licence_names_nothing(spark):
    got = scanned(spark, [
        ("a/1", "This is not released under the MIT License."), ("a/2", "This file isn't licensed under the MIT License."), ("a/3", "Released under the MIT License."),
        ("b/1", NOTICE), ("b/2", "No longer licensed under the Apache License, Version 2.0."), ("c/1", " ".join(licenses.WHOLE["MIT"])), ("d/1", "not " * 50_000 + "licensed"),
        ("g/h.c", "// Released under the MIT License.\nint x;"), ("g/i.c", "int y;"),
    ])
    assert {p: r.own_license for p, r in got.items()} == {
        "a/1": None, "a/2": None, "a/3": "MIT", "b/1": "Apache-2.0", "b/2": None, "c/1": "MIT", "d/1": None, "g/h.c": "MIT", "g/i.c": None,
    }
    assert got["a/1"].license == "MIT" and got["a/1"].licensed_by == "a"
    assert not got["g/h.c"].licence_file and got["g/i.c"].license is None


def test_expressions_of_several_identifiers(spark):
    tag = "// SPDX-License-Identifier: "
    got = scanned(spark, [
        ("1", tag + "(MIT OR Apache-2.0)\nint x;"), ("2", tag + "gpl-2.0-only WITH Classpath-exception-2.0 */"), ("3", tag + "MIT and (bsd-2-clause or GPL-3.0+)"),
        ("4", tag + "MIT"), ("5", tag + "Foo OR Bar"), ("LICENSE", "/* SPDX-License-Identifier: MIT OR ISC */\nmore\nmore"), ("6", tag + "MIT" + " OR ISC" * 20_000), ("7", tag + "MIT or so"), ("8", None),
    ])
    assert {p: r.own_license for p, r in got.items() if p != "6"} == {
        "1": "MIT OR Apache-2.0", "2": "GPL-2.0 WITH Classpath-exception-2.0", "3": "MIT AND (BSD-2-Clause OR GPL-3.0)", "4": "MIT", "5": None, "LICENSE": "MIT OR ISC", "7": "MIT OR so", "8": None,
    }
    assert got["6"].own_license == "MIT" + " OR ISC" * 20_000 and got["1"].own_score == 1.0 and not got["1"].licence_file
    assert got["LICENSE"].licence_file and got["5"].license == "MIT OR ISC"


def test_the_sql_says_the_same_of_planted_cases(spark, tmp_path):
    tag = "# SPDX-License-Identifier: "
    texts = ["This is not released under the MIT License.", "Released under the MIT License.", tag + "(MIT OR Apache-2.0)\nint x;", tag + "mit and (ISC or Foo)", NOTICE, None, "", f"{NOTICE}\nint x;", "no licence"]
    rows = [(k, t, "en", f"s{k % 3}") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    columns = "doc_id path own_license own_score licence_file license licensed_by".split()
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()['op10_license_scans']})").fetchall()
    got = [tuple(r) for r in queries.op10_license_scans(spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(got) == sorted(want)
