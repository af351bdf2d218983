"""Headers, licence texts' beginnings and what stands beside them; the query's inheritance against its SQL."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessellar.llm import html_extract, licenses, queries

CASES = {
    "This file is free software: you can redistribute it under the terms of the GNU Lesser General Public License as published by\n# the Free Software Foundation, either version 3 of the License": "LGPL-3.0",
    "GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License": "LGPL-2.1",
    "Licensed under the GNU GPL, version 2": "GPL-2.0",
    "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License": "GPL-2.0",
    "Copyright (c) 2020, X\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:": "BSD-3-Clause",
    "                                 Apache License\n                           Version 2.0, January 2004\n": "Apache-2.0",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007": "GPL-3.0",
    "// SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
    "# SPDX-License-Identifier: ISC": "ISC",
    "This is free and unencumbered software released into the public domain.": "Unlicense",
    "Copyright 2020 Jane. All rights reserved.": "All-Rights-Reserved",
    "word " * 100_000 + "\nReleased under the MIT License.": "MIT",
    "nothing of the kind": None,
}


def test_headers_and_beginnings(spark):
    rows = [(str(i), t) for i, t in enumerate(CASES)]
    got = {r.path: r.license for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {str(i): k for i, k in enumerate(CASES.values())}


def test_ties_go_to_the_later_name(spark):
    got = licenses.scan(spark.createDataFrame([("a", "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.")], "path string, text string")).first()
    assert (got.license, got.how, got.score) == ("MIT", "own", 1.0)


def test_query_equals_sql_that_weighs_and_inherits_by_itself(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = [(10_000 + 50 * k, t, "en", "web", len(t)) for k, t in enumerate(CASES)] + [(20_001, "plain", "en", "web", 5), (20_002, None, None, "web", 0)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = c.execute(queries.oracle_sql()["op5_license_scan"]).fetchdf()
    got = queries.op5_license_scan(spark, str(tmp_path)).toPandas()
    key = lambda df: sorted((r.doc_id, r.path, None if pd.isna(r.license) else r.license, round(r.score, 6), r.how) for r in df.itertuples())
    assert key(got) == key(want) and {"own", "inherited"} <= set(got.how)


@pytest.mark.parametrize("unit", ["<a ", "x > <a ", "</b>", '<p "', "<!-", "<div>x", "<li>"])
def test_broken_markup_takes_linear_time(unit):
    import time

    began = time.time()
    html_extract.blocks(unit * (400_000 // len(unit)))
    assert time.time() - began < 20


def test_an_open_comment_ends_the_page():
    assert [b.text for b in html_extract.blocks("x > <!-- c")] == ["x >"] and [b.text for b in html_extract.blocks("<p>a<!-- b --> c<p>d <!-- e")] == ["a c", "d"]


def test_names_that_differ_in_case_are_replaced(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id long, url string, html string").withColumn("Text", F.lit("q")).withColumn("N_Chars", F.lit("q"))
    assert html_extract.extract(pages, html_extract.Labeller()).columns == ["page_id", "url", "html", "text", "n_chars"]
