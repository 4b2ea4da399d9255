"""Licences of files: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

Lines that speak of rights (and, of licence files, the whole text) are compared with licence notices and whole licences.
As headers are wrapped at any width, so are the words that follow the start of a line, in several numbers, if the first of
them speak of rights. Different texts are compared once, however many files hold them. A whole licence found counts before
a notice, a notice before a bare claim of copyright, each whatever its cosine. A file without a notice takes the licence
that a licence file gives to the nearest directory above it; directories, not files, are joined with their ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import let
from pageloom.functions.rows import exploded
from pageloom.llm.common import whole, written

#: Cosine from which a text counts as a notice's licence, and as a whole licence (a template of WHOLE words or more).
SIMILAR, SAME, WHOLE = 0.6, 0.8, 80
#: Notices by licence, and what a line must say to be compared.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated this work to the public domain, CC0 1.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE"),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
)
#: Headers that files carry in place of a notice, always over several lines.
HEADERS = tuple(
    (
        name,
        f"{kind} is free software: you can redistribute it and/or modify it under the terms of the GNU {of} General Public"
        f" License as published by the Free Software Foundation, either version {version} of the License, or (at your option)"
        " any later version.",
    )
    for name, kind, of, version in (
        ("GPL-2.0", "This program", "", "2"),
        ("GPL-3.0", "This program", "", "3"),
        ("LGPL-2.1", "This library", "Lesser", "2.1"),
        ("LGPL-3.0", "This library", "Lesser", "3"),
        ("AGPL-3.0", "This program", "Affero", "3"),
    )
)
#: First words of the licences that are too long to be compared whole.
TITLES = tuple(
    (
        name,
        f"GNU {of} GENERAL PUBLIC LICENSE Version {version}, {date} Copyright (C) Free Software Foundation, Inc. Everyone is"
        " permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    )
    for name, of, version, date in (
        ("GPL-2.0", "", "2", "June 1991"),
        ("GPL-3.0", "", "3", "29 June 2007"),
        ("LGPL-2.1", "LESSER", "2.1", "February 1999"),
        ("LGPL-3.0", "LESSER", "3", "29 June 2007"),
        ("AGPL-3.0", "AFFERO", "3", "19 November 2007"),
    )
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of"
    " conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,"
    " this list of conditions and the following disclaimer in the documentation and/or other materials provided with the"
    " distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
    " derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES,"
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF"
    " THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
#: Licences that are compared whole.
LICENCES = (
    ("BSD-2-Clause", f"{_BSD[0]} {_BSD[2]}"),
    ("BSD-3-Clause", f"{_BSD[0]} {_BSD[1]} {_BSD[2]}"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the Software), to deal in the Software without restriction, including without limitation the"
        " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
        " permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright"
        " notice and this permission notice shall be included in all copies or substantial portions of the Software. THE"
        " SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE"
        " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS"
        " OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
        " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS"
        " PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES"
        " OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR"
        " CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF"
        " CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS"
        " SOFTWARE.",
    ),
)
TEMPLATES = NOTICES + HEADERS + TITLES + LICENCES
#: The licence that a text has only if it has no other.
BARE = "Proprietary"
#: Words from a line's start that are compared together, and those of them that must speak of rights.
SIZES, HEAD = (12, 24, 48, 96, 192), 24
CUE = (
    r"licen[sc]e|copyright|spdx-|all rights reserved|creative commons|public domain|free of charge"
    r"|redistribution and use|permission to use|cc by|cc0"
)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _key(words: Column) -> Column:
    """Half of a SHA-256 in place of a text where rows are only told apart."""
    return F.unhex(F.substring(F.sha2(words, 256), 1, 32))


def _counted(words: Column) -> Column:
    """array<struct<token, c>> of the different words of a list."""

    def at_starts(ordered: Column, starts: Column) -> Column:
        end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(ordered))
        return F.transform(starts, lambda at, k: F.struct(F.get(ordered, at).alias("token"), (end(k) - at).alias("c")))

    def runs(ordered: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(ordered) - 1)
        return let(F.filter(at, lambda j: (j == 0) | (F.get(ordered, j) != F.get(ordered, j - 1))), lambda s: at_starts(ordered, s))

    return let(F.sort_array(words), runs)


def _weighed(counts: DataFrame, key: str, idf: DataFrame, n: DataFrame) -> DataFrame:
    """key, token, w with w = count * (ln((1 + N) / (1 + df)) + 1). counts: key, token, c."""
    rows = counts.join(idf, "token", "left").crossJoin(F.broadcast(n))  # n is one row
    weight = F.col("c") * (F.log((1.0 + F.col("N")) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0)
    return rows.select(key, "token", weight.alias("w"))


def _norms(weighed: DataFrame, key: str) -> DataFrame:
    return weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def matches(segments: DataFrame, templates: DataFrame) -> DataFrame:
    """Best licence of each different segment: key, b (place in the order of matches, license, cosine). segments: key, words
    (one space between), files (how many hold it; 0 for runs of words, whose lines are counted already)."""
    counted = _counted(F.split("words", " ")).alias("counts")
    segs = written(segments.select(F.monotonically_increasing_id().alias("seg"), "key", "files", counted), "segments")
    counts = exploded(segs, "counts", "seg", "files").select("seg", "files", "e.token", "e.c")
    # Statistics over all files: every file's copy of a line counts.
    idf = written(counts.groupBy("token").agg(F.sum("files").alias("df")), "idf")
    n = segs.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("N"))
    listed = templates.select(F.monotonically_increasing_id().alias("tpl"), "license", tokens(F.col("text")).alias("toks"))
    # 0 for whole licences, 1 for notices, 2 for what says no more than that there are rights.
    kind = F.when(F.col("license") == BARE, 2).when(F.size("toks") >= WHOLE, 0).otherwise(1)
    listed = written(listed.withColumn("kind", kind), "templates")
    own = exploded(listed, "toks", "tpl").groupBy("tpl", F.col("e").alias("token")).agg(F.count("*").alias("c"))
    own = _weighed(own, "tpl", idf, n)
    right = own.join(_norms(own, "tpl"), "tpl").select("tpl", "token", (F.col("w") / F.col("norm")).alias("tw"))
    right = written(right, "weights")
    # The length of a segment is made of all its words; beyond that only words of templates count.
    counts = counts.select("seg", "token", "c")
    norms = _norms(_weighed(counts, "seg", idf, n), "seg")
    shared = right.select("token").distinct()
    left = _weighed(counts.join(shared, "token"), "seg", written(idf.join(shared, "token"), "shared"), n)
    left = left.join(norms, "seg").select("seg", "token", (F.col("w") / F.col("norm")).alias("w"))
    dots = left.join(right, "token").groupBy("seg", "tpl").agg(F.round(F.sum(F.col("w") * F.col("tw")), 6).alias("cosine"))
    least = F.when(F.col("kind") == 0, SAME).otherwise(SIMILAR)
    named = dots.join(listed.select("tpl", "license", "kind"), "tpl").where(F.col("cosine") >= least)
    # The match that counts of several: its kind, the best cosine, then the licence first in order of name.
    first = F.min(F.struct("kind", (-F.col("cosine")).alias("order"), "license", "cosine")).alias("b")
    return segs.select("seg", "key").join(named.groupBy("seg").agg(first), "seg").select("key", "b")


def _starts(lines: Column) -> Column:
    """The words that follow the start of a line, as many as are ever compared, where the first speak of rights."""
    most = SIZES[-1]
    own = F.filter(F.transform(lines, lambda x: F.slice(tokens(x), 1, most)), lambda t: F.size(t) > 0)

    def runs(listed: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(listed), F.lit(1)))
        each = F.transform(at, lambda i: F.array_join(F.slice(F.flatten(F.slice(listed, i, most)), 1, most), " "))
        return F.filter(each, lambda x: F.substring_index(x, " ", HEAD).rlike(CUE))

    return let(own, runs)


def _sized(words: Column) -> Column:
    """The first words of a run in each of the sizes, shorter runs whole."""
    size = F.size(F.split(words, " "))
    cut = [F.when(size > before, F.substring_index(words, " ", n)) for before, n in zip((0, *SIZES), SIZES, strict=False)]
    return F.filter(F.array(*cut), lambda x: x.isNotNull())


def licences(files: DataFrame, templates: DataFrame, path: str = "path", text: str = "text", is_licence: str | None = None):
    """One row per file: path, license, cosine, how (own, inherited, none), from_dir.

    path: folders and name with `/` between. is_licence: a condition (SQL) that says which files are licence files;
    by default the name (LICENSE, LICENCE, COPYING, NOTICE, with any ending). A licence file gives its licence to its
    folder; of several in a folder the best match counts, then the name of the licence. Null and empty texts have no
    notice; null paths read as the empty path, whose folder is the root. Repeated rows give rows like any other; an
    empty table gives an empty table; a table without columns named here is the caller's error, others are ignored.
    """
    named = F.expr(is_licence) if is_licence else F.col(path).rlike(r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$")
    rows = files.select(
        F.coalesce(path, F.lit("")).alias("path"),
        F.coalesce(named, F.lit(False)).alias("gives"),
        whole(text).alias("text"),
    )
    low = F.lower("text")
    # Most texts have no cue; only those that have are cut into lines.
    split = F.when(low.rlike(CUE), F.split(low, "\n", -1)).otherwise(F.array().cast("array<string>"))
    words = lambda x: F.array_join(tokens(x), " ")
    lines = F.transform(F.filter(split, lambda x: x.rlike(CUE)), words)
    segs = F.when(F.col("gives"), F.concat(lines, F.array(words(F.col("text"))))).otherwise(lines)
    # Rows are numbered as they are written, so that repeated paths stay apart.
    table = written(
        rows.select("path", "gives", segs.alias("segs"), _starts(split).alias("starts"), F.monotonically_increasing_id().alias("row")),
        "files",
    )
    each = exploded(table, "segs", "row").select("row", F.col("e").alias("words"), F.lit(1).alias("one"))
    runs = exploded(exploded(table, "starts", "row").select("row", F.col("e").alias("run")), _sized(F.col("run")), "row")
    each = each.unionByName(runs.select("row", F.col("e").alias("words"), F.lit(0).alias("one"))).where("words <> ''")
    each = each.withColumn("key", _key(F.col("words")))
    # Keys stand for the texts wherever rows move; each different text moves once, from every task that holds it.
    lines = written(each.groupBy("row", "key").agg(F.max("one").alias("one")), "lines")
    told = lines.select("key", F.lit(None).cast("string").alias("words"), "one")
    segments = each.select("key", "words", F.lit(0).alias("one")).unionByName(told)
    best = matches(segments.groupBy("key").agg(F.max("words").alias("words"), F.sum("one").alias("files")), templates)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    found = lines.join(best, "key").groupBy("row").agg(F.min("b").alias("b"))
    found = written(table.select("path", "gives", folder.alias("dir"), "row").join(found, "row", "left").drop("row"), "found")
    given = found.where("gives AND b IS NOT NULL").groupBy("dir").agg(F.min("b").alias("b"))
    # Each folder once, with itself and all folders above it; the longest that is given a licence is the nearest.
    folders = found.select("dir").distinct()
    parts = F.split("dir", "/", -1)
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    reach = exploded(folders, F.array_distinct(above), "dir").select("dir", F.col("e").alias("up"))
    heirs = (
        reach.join(given.select(F.col("dir").alias("up"), "b"), "up")
        .groupBy("dir")
        .agg(F.max_by(F.struct("up", "b"), F.length("up")).alias("h"))
    )
    out = found.select("path", "dir", "b").join(heirs, "dir", "left")
    own = F.col("b").isNotNull()
    return out.select(
        "path",
        F.when(own, F.col("b.license")).otherwise(F.col("h.b.license")).alias("license"),
        F.when(own, F.col("b.cosine")).otherwise(F.col("h.b.cosine")).alias("cosine"),
        F.when(own, "own").when(F.col("h").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(~own, F.col("h.up")).alias("from_dir"),
    )
