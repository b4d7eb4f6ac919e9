"""Sentences with slots, notices, machine-readable lines, and rules that a longer or unknown clause rules out."""

import duckdb
import pytest

from tessera.llm import licenses

from .test_corpus import BSD, BSD3

HOLDER = BSD3.replace("the copyright holder nor the names of its", "Example Inc. and Sons, LLC nor the names of its")
OTHER = BSD + "\n\n3. Neither the name of the author may be used in advertising."
CASES = [
    (HOLDER.replace("Inc. and", "Inc and"), ["BSD-3-Clause"]),
    (BSD3, ["BSD-3-Clause"]),
    (BSD, ["BSD-2-Clause"]),
    (OTHER, []),
    ("SPDX-License-Identifier: MIT", ["MIT"]),
    ("// SPDX-License-Identifier: GPL-2.0-only\nint main;", ["GPL-2.0-only"]),
    ("# SPDX-License-Identifier: Apache-2.0\n", ["Apache-2.0"]),
    ("This project is licensed under the MIT License.", ["MIT"]),
    ("This software is released under the MIT license, see LICENSE.", ["MIT"]),
    ("The library of ours is distributed under the terms of the Apache License, Version 2.0. More follows.", ["Apache-2.0"]),
    ("This package is available under the GNU General Public License v3", ["GPL-3.0"]),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.", ["GPL-2.0-only"]),
    ("This program is free software; you can redistribute it and/or modify it\n * under the terms of the GNU General Public License version 2 as\n * published by the Free Software Foundation.", ["GPL-2.0-only"]),
    ("This house is not licensed under the MIT of old times and more", []),
    ("This work is licensed under the GNU General Public License version 3.", ["GPL-3.0"]),
    ("Neither the name", []),
]


def test_cases(spark):
    got = licenses.recognise(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string")).orderBy("i").collect()
    assert [(r.i, r.licenses) for r in got] == [(i, w) for i, (_, w) in enumerate(CASES)]


@pytest.mark.parametrize("dots", [True, False])
def test_sql_agrees_where_sentences_are_lines(spark, tmp_path, dots):
    """The SQL cuts at every line, so texts of one line a sentence."""
    texts = [t.replace("\n\n", "\n") for t, _ in CASES if "\n *" not in t] + [None, ""]
    texts = texts if dots else [t and t.rstrip(".") for t in texts]
    path = str(tmp_path / "documents.parquet")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    cur = con.execute(licenses.OP4_SQL)
    names = [d[0] for d in cur.description]
    assert sorted(tuple(r) for r in licenses.op4_licenses(spark, str(tmp_path)).select(names).collect()) == sorted(cur.fetchall())
