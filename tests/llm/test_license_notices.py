"""Licence notices in all their places: alone on a line, inside one, and over several paragraphs."""

import duckdb

from concord.llm import licenses


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licenses.scan(df).collect()}


def test_every_template_finds_itself_on_a_line(spark):
    rows = found(spark, [f"some text\n{text}\nmore" for _, text in licenses.TEMPLATES])
    assert [(rows[i].license, rows[i].dice, rows[i].line, rows[i].n_lines) for i in range(len(rows))] == [(name, 1.0, 1, 1) for name, _ in licenses.TEMPLATES]


def test_bare_all_rights_reserved(spark):
    texts = ["All rights reserved.", "x\n\nALL RIGHTS RESERVED\n", "all rights", licenses.TEMPLATES[-2][1]]
    rows = found(spark, texts)
    assert [rows[i].license for i in range(4)] == ["All-rights-reserved-line", "All-rights-reserved-line", None, "All-rights-reserved"]


def test_bare_notices_of_the_tables(spark):
    """The documents with the bare line, which all had no licence, get one; the SQL agrees."""
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path)
    got = licenses.scan(docs).collect()
    bare = {r.doc_id for r in docs.collect() if "All rights reserved." in (r.text or "").split("\n")}
    assert bare and bare <= {r.doc_id for r in got if r.license}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    assert sorted(c.sql(licenses.oracle_sql()).fetchall()) == sorted(tuple(r) for r in got)


MIT = """MIT License

Copyright (c) 2020 Jo Doe

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
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
"""
APACHE = """Copyright 2020 Jo Doe

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
CODE = "\n\n".join(f"def f{i}(x):\n    return x + {i}" for i in range(40))


def test_notices_over_several_paragraphs(spark):
    texts = [MIT, GPL, GPL.replace("#", "").replace("\n\n", "\n \n"), APACHE, f"{CODE}\n\n{MIT}\n\n{CODE}"]
    rows = found(spark, texts)
    assert [rows[i].license for i in range(4)] == ["MIT-text", "GPL-notice", "GPL-notice", "Apache-2.0-notice"]
    assert rows[4].license == "MIT-text" and rows[4].line == CODE.count("\n") + 2 + 4
    assert min(r.dice for r in rows.values()) > 0.95


def test_notices_inside_a_line(spark):
    rows = found(spark, ["Copyright 2020 X. Licensed under the MIT License. See LICENSE for details.", "a\nCopyright 2020 X. All rights reserved. 3 of 4.\nb", "All the rights that the king had reserved."])
    assert [(rows[i].license, rows[i].dice, rows[i].line, rows[i].n_lines) for i in range(3)] == [("MIT-licensed", 1.0, 0, 0), ("All-rights-reserved-line", 1.0, 1, 0), (None, 0.0, None, 0)]


def test_windows_by_brute_force():
    """Every run of words within reach, compared in full; repeated, broken and overlapping notices among them."""
    own = licenses.matcher(licenses.TEMPLATES, licenses.THRESHOLD)
    mit, cc = "Licensed under the MIT License. ", "Licensed under CC BY 4.0 today. "
    for text in ("all rights reserved " * 6, mit * 3 + "x " + cc, "under the MIT the MIT License\nlicensed under the BSD 3-Clause or 2-Clause License", "this work is licensed under\n\n# the GNU general, public, license v version 2 3 all rights are reserved"):
        words, expected = licenses.words(text), {}
        for i, s in enumerate(own.sets):
            for a in range(len(words)):
                for b in range(a + 2, min(len(words), a + own.reach[i] + 1) + 1):
                    run = licenses.bigrams(words[a:b])
                    expected[-i] = max(expected.get(-i, 0.0), 2.0 * len(run & s) / (len(run) + len(s)))
        assert {k: d for d, k, _ in own.windows(text)} == {k: d for k, d in expected.items() if d >= own.threshold}
