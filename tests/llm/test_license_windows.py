"""Notices among other words, wrapped ones and full licence texts."""

from pathlib import Path

import pytest

from tessellar.llm import licenses

GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
MIT = "MIT License\n\nCopyright (c) 2020 Jane Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal in the Software without restriction.\n"
FULL = {"GPL-3": "GPL-3.0", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0"}


def test_headers_and_full_texts(spark):
    rows = {
        "a/x.py": ("Copyright 2020 Jane Doe. All rights reserved.", "All-Rights-Reserved"),
        "b/x.py": ("(c) 2021 Example Corp. Released under the MIT License.", "MIT"),
        "c/x.py": ("// Copyright 2020 Jane Doe. Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        "d/x.py": (GPL, "GPL-3.0"),
        "e/x.py": (GPL.replace("GNU General", "GNU Affero General") + "\nCopyright 2020 Jane Doe. All rights reserved.", "AGPL-3.0"),
        "f/LICENSE": (MIT, "MIT"),
        "g/x.c": ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not\n * distributed with this file */", "MPL-2.0"),
        "h/x.py": ("the submit licenses of all rights are reserved for public versions", None),
    }
    got = {r.path: r.license for r in licenses.scan(spark.createDataFrame([(p, t) for p, (t, _) in rows.items()], "path string, text string")).collect()}
    assert got == {p: want for p, (_, want) in rows.items()}


def test_full_texts_of_the_system(spark):
    there = {n: Path("/usr/share/common-licenses", n) for n in FULL if Path("/usr/share/common-licenses", n).exists()}
    if not there:
        pytest.skip("no licence texts here")
    rows = [(f"{n}/LICENSE", p.read_text()) for n, p in there.items()] + [(f"{n}/src/a.py", "code") for n in there]
    got = {r.path: (r.license, r.how) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {f"{n}/LICENSE": (FULL[n], "own") for n in there} | {f"{n}/src/a.py": (FULL[n], "inherited") for n in there}


def test_every_window_holds_a_mark():
    for phrases in (*licenses.TEMPLATES.values(), *licenses.PHRASES.values()):
        for p in phrases:
            assert any(m in licenses.window(p) for m in licenses.MARKS), p
