"""Licence scan: headers, licence files and inheritance on a small tree."""

from churnlake.llm import licenses as L

MIT = "Released under the MIT License."
GPL = "This work is licensed under the GNU General Public License, version 3."


def scanned(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, path string, text string, licence string")
    return {r.doc_id: r for r in L.scan(df).collect()}


def test_tree(spark):
    body = "some words of a file " * 20
    got = scanned(spark, [
        (1, "a/LICENSE", MIT + " " + body, "c"), (2, "a/b/c/x", body, "c"), (3, "a/b/NOTES", GPL, "c"),
        (4, "a/b/y", f"{body}\n  Licensed under CC BY-NC 4.0.\n{body}", "c"), (5, "z/x", body, "c"), (6, "top", body, "c"),
        (7, None, None, "c"), (8, "a/q", "", "c"), (9, "a/r", "A new licence of our own, unlike any other.", "c"),
        (10, "abc/x", body, "c")])
    assert (got[1].licence, got[1].origin) == ("MIT", "file")
    assert (got[2].licence, got[2].origin, got[2].origin_dir) == ("GPL-3.0", "inherited", "a/b")
    assert (got[3].licence, got[3].origin) == ("GPL-3.0", "file")
    assert (got[4].licence, got[4].origin) == ("CC-BY-NC-4.0", "header")
    assert {got[i].origin for i in (5, 6, 7, 10)} == {"none"}
    assert got[8].licence == got[9].licence == "MIT" and got[9].origin == "inherited"


def test_ties_in_a_directory(spark):
    got = scanned(spark, [(1, "d/1", MIT, "c"), (2, "d/2", "Licensed under CC BY 4.0.", "c"), (3, "d/3", "", "c"), (3, "d/3", "", "c")])
    assert got[3].licence == "CC-BY-4.0"


def test_every_template_is_its_own_nearest(spark):
    rows = [(i, f"{i}/x", f"Before.\n{text.upper()}\nAfter it.", "c") for i, (_, text) in enumerate(L.TEMPLATES)]
    got = scanned(spark, rows)
    assert [got[i].licence for i in range(len(rows))] == [n for n, _ in L.TEMPLATES]
    for i, (_, text) in enumerate(L.TEMPLATES):
        assert got[i].similarity == 1.0 or ("v. 2.0" in text and got[i].similarity > 0.9) or "; either" in text  # a sentence ends inside


def test_usual_notices(spark):
    notices = {
        "// SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */": "GPL-2.0",
        "Licensed under the MIT license": "MIT", "GNU GENERAL PUBLIC LICENSE": "GPL", "Released under the ISC License.": "ISC",
        "GNU AFFERO GENERAL PUBLIC LICENSE": "AGPL-3.0", "This work is licensed under the GNU Affero General Public License version 3": "AGPL-3.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\")": "Apache-2.0", "The MIT License (MIT)": "MIT",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "GPL-3.0",
        " * it under the terms of the GNU General Public License as published by": "GPL",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.": "BSD-3-Clause",
        "SPDX-License-Identifier: Proprietary-Of-Ours": None, "The driver showed a licence to the officer.": None,
        "A software license of any kind needs a lawyer, said the general public.": None}
    got = scanned(spark, [(i, f"{i}/x", f"words before\n{text}\nwords after", "c") for i, text in enumerate(notices)])
    assert {t: got[i].licence for i, t in enumerate(notices)} == notices


def test_inherited_from_several_depths(spark):
    got = scanned(spark, [(1, "a/LICENSE", MIT, "c"), (2, "a/b/c/d/e", "", "c"), (3, "a/b/c/COPYING", GPL, "c"), (4, "a/b/x", "", "c"), (5, "a/y", "", "c")])
    assert [(got[i].licence, got[i].origin_dir) for i in (2, 4, 5)] == [("GPL-3.0", "a/b/c"), ("MIT", "a"), ("MIT", "a")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, path string, text string")
    assert L.scan(df).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a/b", MIT)], "doc_id long, path string, text string")
    plan = L.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
