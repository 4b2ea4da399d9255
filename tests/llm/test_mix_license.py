from __future__ import annotations

import time

import pytest
from helpers import CLASH, documents, hostile, rows
from pyspark.sql import functions as F

from pageloom.llm import license_scan, mixing


def test_rates_and_counts(spark):
    docs = documents(spark, [f"t{i}" for i in range(3000)], clash=False).withColumn(
        "source", F.when(F.col("doc_id") % 10 == 0, "small").when(F.col("doc_id") % 10 == 1, None).otherwise("big")
    )
    weights = spark.createDataFrame([("small", 1.0), ("big", 1.0), (None, 1.0), ("absent", 5.0)], "source string, weight double")
    out = mixing.mixed(docs, weights, 3)
    n = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert all(abs(v - 1000) < 150 for v in n.values()) and len(n) == 3
    copies = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("repeats").alias("r"), F.countDistinct("copy_no").alias("c"))
    assert copies.where("n <> r or n <> c").count() == 0
    assert rows(mixing.mixed(docs.repartition(9), weights, 3)) == rows(out)


def test_large_means_are_drawn_in_parts(spark):
    docs = documents(spark, ["t"] * 50, clash=False).withColumn("source", F.when(F.col("doc_id") == 0, "one").otherwise("rest"))
    weights = spark.createDataFrame([("one", 4000.0), ("rest", 1.0)], "source string, weight double")
    r = mixing.rates(docs, weights).where("source = 'one'").first()
    assert r.parts == 1 and len(r.cdf) < 300 and abs(r.cdf[-1] - 1) < 1e-9
    docs = documents(spark, ["t"] * 2000, clash=False).withColumn("source", F.when(F.col("doc_id") == 0, "one").otherwise("rest"))
    r = mixing.rates(docs, weights).where("source = 'one'").first()
    assert r.parts == 32
    n = mixing.mixed(docs, weights).where("source = 'one'").count()
    assert abs(n - r.rate) < 5 * r.rate**0.5


def test_rows_without_doc_id_draw_apart(spark):
    docs = documents(spark, [f"t{i}" for i in range(2000)], [None] * 2000, clash=False)
    docs = docs.withColumn("source", F.when(F.col("text") < "t5", "a").otherwise("b"))
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    out = mixing.mixed(docs, weights, 4)
    n = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert len(n) == 2 and all(abs(v - 1000) < 150 for v in n.values())
    by_text = out.groupBy("text").agg(F.count("*").alias("n"), F.max("repeats").alias("r"))
    assert by_text.where("n <> r").count() == 0 and by_text.select("r").distinct().count() > 2
    assert out.select("mix_key").distinct().count() == out.count()
    assert rows(mixing.mixed(docs.repartition(9), weights, 4)) == rows(out)


def test_mix_hostile(spark):
    docs = hostile(spark)
    out = mixing.mixed(docs, mixing.tempered(docs))
    kept = [c for c in docs.columns if c not in ("copy_no", "repeats", "mix_key")]
    assert out.columns == [*kept, "copy_no", "repeats", "mix_key"]
    assert mixing.mixed(docs.limit(0), mixing.tempered(docs.limit(0))).count() == 0
    none = spark.createDataFrame([("s", None)], "source string, weight double")
    assert mixing.mixed(docs, none).count() == 0


def scan(spark, files, **extra):
    schema = f"path string, text string, {CLASH}"
    df = spark.createDataFrame([(*f, *["x"] * CLASH.count(","), "x") for f in files], schema)
    templates = spark.createDataFrame(license_scan.NOTICES, "license string, text string")
    return license_scan.licences(df, templates, **extra)


def test_own_and_inherited(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License."),
        ("a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
        ("a/x.py", "code"),
        ("a/b/c/d/y.py", ""),
        ("a/b/z.py", "# SPDX-License-Identifier: GPL-3.0-only\ncode " * 2000),
        ("other/w.py", None),
        ("other/w.py", None),
        (None, "This work is licensed under the GNU General Public License, version 3."),
        ("ab/v.py", "a licence to nothing in particular, whatever the reader may think of it"),
    ]
    got = sorted(((r.path, r.license, r.how, r.from_dir) for r in scan(spark, files).collect()), key=repr)
    assert got == sorted(
        [
            ("a/LICENSE", "MIT", "own", None),
            ("a/b/LICENSE.txt", "Apache-2.0", "own", None),
            ("a/x.py", "MIT", "inherited", "a"),
            ("a/b/c/d/y.py", "Apache-2.0", "inherited", "a/b"),
            ("a/b/z.py", "GPL-3.0", "own", None),
            ("other/w.py", None, "none", None),
            ("other/w.py", None, "none", None),
            ("", "GPL-3.0", "own", None),
            ("ab/v.py", None, "none", None),
        ],
        key=repr,
    )


def test_wrapped_headers(spark):
    mpl = (
        "/* This Source Code Form is subject to the terms of the Mozilla Public\n"
        " * License, v. 2.0. If a copy of the MPL was not distributed with this\n"
        " * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n"
    )
    gpl = (
        "# This program is free software: you can redistribute it and/or modify\n"
        "# it under the terms of the GNU General Public License as published by\n#\n"
        "# the Free Software Foundation, either version 3 of the License, or\n"
        "# (at your option) any later version.\n"
    )
    files = [("a.js", mpl + "let x = 1;\n"), ("b.py", gpl + "x = 1\n"), ("c.py", gpl.replace(" 3 ", " 2 ")), ("d.py", "x = 1\ny = 2")]
    df = spark.createDataFrame(files, "path string, text string")
    templates = spark.createDataFrame(license_scan.NOTICES + license_scan.HEADERS, "license string, text string")
    got = {r.path: (r.license, r.how) for r in license_scan.licences(df, templates).collect()}
    assert got == {"a.js": ("MPL-2.0", "own"), "b.py": ("GPL-3.0", "own"), "c.py": ("GPL-2.0", "own"), "d.py": (None, "none")}


def test_root_licence_and_empty_table(spark):
    got = scan(spark, [("LICENSE", "Released under the MIT License."), ("p/q.py", "x")]).collect()
    assert {r.path: (r.license, r.from_dir) for r in got}["p/q.py"] == ("MIT", "")
    df = spark.createDataFrame([], "path string, text string")
    templates = spark.createDataFrame(license_scan.NOTICES, "license string, text string")
    assert license_scan.licences(df, templates).count() == 0
    with pytest.raises(Exception, match="text"):
        license_scan.licences(df.drop("text"), templates).count()


def test_texts_are_stored_once(spark, monkeypatch):
    stored, written = {}, license_scan.written

    def noted(df, name):
        stored[name] = set(df.columns)
        return written(df, name)

    monkeypatch.setattr(license_scan, "written", noted)
    files = [("a/x.py", "Released under the MIT License.\ncode"), ("a/y.py", "Released under the MIT License.\ncode"), ("b.py", "x")]
    assert sorted((r.path, r.license) for r in scan(spark, files).collect()) == [("a/x.py", "MIT"), ("a/y.py", "MIT"), ("b.py", None)]
    assert [name for name, columns in stored.items() if columns & {"segs", "starts", "words", "text"}] == ["files"]


BSD2 = """Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.

"""
BSD3 = """* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.

"""
AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
MIT = """MIT License

Copyright (c) 2019 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
ISC = """Copyright (c) 2018, Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
APACHE = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.
"""
GPL = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.
"""
MPL = """Mozilla Public License Version 2.0
==================================

1. Definitions
--------------

1.1. "Contributor"
    means each individual or legal entity that creates, contributes to
    the creation of, or owns Covered Software.
"""


def test_real_licence_files_and_headers(spark):
    note = "// Copyright 2014 The Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n"
    note += "// license that can be found in the LICENSE file.\npackage x\n"
    narrow = (
        "This program\nis free software:\nyou can redistribute\nit and/or modify\nit under the\nterms of the\nGNU General\n"
        "Public License\nas published by\nthe Free Software\nFoundation, either\nversion 2 of\nthe License, or\n"
        "(at your option)\nany later version.\n"
    )
    commented = "".join(f" * {line}\n" for line in (BSD2 + AS_IS).splitlines())
    want = {
        "b2/LICENSE": (BSD2 + AS_IS, "BSD-2-Clause"),
        "b3/LICENSE": (BSD2 + BSD3 + AS_IS, "BSD-3-Clause"),
        "m/LICENSE": (MIT, "MIT"),
        "i/LICENSE": (ISC, "ISC"),
        "a/LICENSE": (APACHE + "words of it " * 800, "Apache-2.0"),
        "g/COPYING": (GPL + "words of it " * 800, "GPL-3.0"),
        "p/LICENSE": (MPL + "words of it " * 800, "MPL-2.0"),
        "b3/x.go": (note, "BSD-3-Clause"),
        "n/x.c": (narrow, "GPL-2.0"),
        "c/x.c": (f"/*\n{commented} */\nint x;\n", "BSD-2-Clause"),
        "c/y.c": ("/* Copyright 2001 Some Body. All rights reserved. */\nint y;\n", "Proprietary"),
        "b2/z.c": ("int z;", "BSD-2-Clause"),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in want.items()], "path string, text string")
    templates = spark.createDataFrame(license_scan.TEMPLATES, "license string, text string")
    got = {r.path: r.license for r in license_scan.licences(df, templates).collect()}
    assert got == {k: v[1] for k, v in want.items()}


def test_many_lines_with_a_cue(spark):
    text = "\n".join(f"package {i} by author{i * 7919 % 10007} under the license of kind {i % 13}" for i in range(20_000))
    df = spark.createDataFrame([("NOTICE", text), ("x.py", "")], "path string, text string")
    templates = spark.createDataFrame(license_scan.TEMPLATES, "license string, text string")
    start = time.monotonic()
    assert license_scan.licences(df, templates).count() == 2
    assert time.monotonic() - start < 60
