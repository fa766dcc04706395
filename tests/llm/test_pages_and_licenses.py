import re
import time
from html.parser import HTMLParser

import duckdb

from cargolex.llm import html_text, licenses
from cargolex.llm.html_text import render
from cargolex.llm.sql import SQL


class Visible(HTMLParser):
    """Words of the table's pages that no hidden element holds, by another parser."""

    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("head", "script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.words += re.findall(r"\w+", data)


def test_all_visible_words_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        p = Visible()
        p.feed(r.html)
        p.close()
        assert "".join(re.findall(r"\w+", got[r.page_id])) == "".join(p.words), r.page_id
        assert not re.search(r"[ \t]$|\n\n\n", got[r.page_id], re.M)


def test_layout():
    assert render("a<p>b<p>c<div>d<div>e") == "a\n\nb\n\nc\n\nd\ne"
    assert render("<ul><li>x<li>y y<br>z<ol start=9><li>p<li>q</ol><li></ul>t") == "- x\n- y y\n  z\n  9. p\n  10. q\n-\n\nt"
    assert render("<table><tr><th>n<th>long<tr><td>aaaa<td>b<p>c<tr><td colspan=2>wide wide wide<td>x</table>") == "n     long\naaaa  b\n\n      c\nwide wide wide  x"
    assert render("<table><tr><td>1<table><tr><td>in<td>ner</table><td>2</table>") == "1        2\n\nin  ner"
    assert render("<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>") == "A  b\n   c\nd  e"
    assert render("<table><tr><td>a<td rowspan=3 colspan=2>B<td>c<tr><td>d<td>e<tr><td>f<td>g<tr><td>h<td>i<td>j<td>k</table>") == "a  B     c\nd        e\nf        g\nh  i  j  k"
    assert render("<pre>a  b\n\n c</pre> <b>x</b><i>y</i>  z\n w") == "a  b\n\n c\n\nxy z w"
    assert render("<blockquote>q<p>r</blockquote>s") == "  q\n\n  r\n\ns"


def test_hidden_parts():
    assert render("<title>t</title>v<script>var t='</p>';</script><style>x</style><div hidden>h<p>i</div><span style='Display: none'>n</span><!-- c --><template>q</template>w") == "vw"
    assert render("<head><meta a><title>x</title><p>y") == "y"
    assert render("&lt;p&gt; &amp;amp; a < b <3 &copy;") == "<p> &amp; a < b <3 ©"


def test_any_depth():
    deep = 5000
    assert render("<div>" * deep + "a<div style='display:none'>secret</div>b<p hidden>no") == "ab"
    assert render("<b>" * deep + "a<ol><li>x<li>y</ol>") == "a\n\n1. x\n2. y"
    lists = render("<ul><li>w" * deep)
    assert lists.count("w") == deep and len(lists) < deep * (html_text.INDENT + 10)
    assert render("<table><tr><td>" * 300 + "x<td>y") == "x  y" or "".join(render("<table><tr><td>" * 300 + "x<td>y").split()) == "xy"


def test_padding_is_within_a_constant_of_the_text():
    long = "<table>" + "<tr><td>a<td>b" * 1000 + f"<tr><td>{'word ' * 4000}<td>c</table>"
    out = render(long)
    assert len(out) < 10 * len(long) and sum(x.count("a") for x in out.split("\n")) == 1000 and out.count("word") == 4000
    wide = "<table><tr>" + f"<td>{'x' * 200}" * 300 + ("<tr>" + "<td>a" * 300) * 300 + "</table>"
    assert len(render(wide)) < 10 * len(wide)
    assert len(render("<table>" + "<tr><td colspan=1000 rowspan=60000>a<td>b" * 2000)) < 1_000_000


def test_broken_pages_take_one_pass():
    assert render("") == "" and render("<") == "<" and render("<a") == "<a" and render("</p>x</div></b>") == "x"
    began = time.time()
    for x in ("<a " * 20000, "<div>" * 30000 + "x", "<table><tr><td>" * 3000, '<a ="' * 20000, "<" * 100000, "<!--" * 50000, "<li>" * 30000):
        render(x)
    assert time.time() - began < 30


def test_quotes_that_never_end_take_one_pass():
    for broken in ("<a b=\"><a c='\" ", "< ", '<a b="', "<p title='x>y'>t</p><a b=\"", "<td", "<a b='\""):
        began = time.time()
        out = html_text.render("<p>first</p>" + broken * (1_000_000 // len(broken)) + " > last")
        assert time.time() - began < 20 and out.startswith("first") and out.endswith("last"), broken


def test_visible_parts_of_an_invisible_one():
    page = '<div style="visibility:hidden">no<p style="visibility:visible">yes</p><table><tr><td>no<td style="visibility: visible">cell</table></div><div style="display:none"><p style="visibility:visible">no</p></div>end'
    assert html_text.render(page).split() == ["yes", "cell", "end"]


def test_page_table(spark):
    df = spark.createDataFrame([(1, None, "u", "x"), (2, "", "u", "x"), (2, "<b>y", "u", "x")], "page_id long, html string, url string, text string")
    assert sorted((r.page_id, r.text) for r in html_text.extract(df).collect() if r.text is not None) == [(2, ""), (2, "y")]
    assert html_text.extract(df).filter("text is null").count() == 1 and html_text.extract(df.limit(0)).count() == 0


MIT = """Copyright (c) X

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def same_as_sql(df):
    """The SQL of the query says the same of these documents."""
    db = duckdb.connect()
    db.register("documents", df.select("doc_id", "text").toPandas())
    want = db.sql(f"select doc_id, n_sentences, sentence_ids, licenses from ({SQL['op10_license_scan']})").fetchall()
    assert sorted(map(tuple, licenses.scan(df).collect())) == sorted(want)


def test_licenses(spark):
    cases = {
        1: (None, ""), 2: ("", ""), 3: ("Prose about a license. It ends.", ""), 4: (MIT, "MIT"), 5: (BSD, "BSD-2-Clause"), 6: (BSD + NAMES, "BSD-3-Clause"),
        7: ("X y.\nThis work is licensed under the GNU General Public License, version 3.\nz", "GPL-3.0"), 8: ("Released under the MIT License. Licensed under the Apache License, Version 2.0!", "MIT,Apache-2.0"),
        9: ("# SPDX-License-Identifier: BSD-3-Clause\ncode", "BSD-3-Clause"), 10: ("Licensed under the GNU General Public License, version 30.", ""), 11: (MIT.split("\n\n")[2], ""), 12: ("spdx license identifier  mpl 2 0", "MPL-2.0"),
    }
    df = spark.createDataFrame([(i, t, "x", 0) for i, (t, _) in cases.items()], "doc_id long, text string, licenses string, n_sentences int")
    got = {r.doc_id: r.licenses for r in licenses.scan(df).collect()}
    assert got == {i: x for i, (_, x) in cases.items()}
    same_as_sql(df)
    assert licenses.scan(df.limit(0)).count() == 0


APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
"""
GNU = """    %s is free software%s you can redistribute it and/or modify
    it under the terms of the GNU %sGeneral Public License as published by
    the Free Software Foundation%s either version %s of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
"""
MPL = """ * This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""


def test_official_headers(spark):
    cases = [
        ("# SPDX-License-Identifier: MIT\nimport x", "MIT"), ("/* SPDX-License-Identifier: GPL-2.0-only */", "GPL-2.0"), ("// SPDX-License-Identifier: LGPL-2.1+\n", "LGPL-2.1-or-later"),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nx", "MIT,Apache-2.0,BSD-3-Clause"), ("SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note. And on", "GPL-2.0"), ("SPDX-License-Identifier: MIT-0", ""),
        (APACHE, "Apache-2.0"), (APACHE.split("\n", 1)[1], "Apache-2.0"), (APACHE.replace("# ", "").replace("\n#\n", "\n"), "Apache-2.0"),
        (APACHE.replace("Apache License", "Educational Community License").replace("http://www.apache.org/licenses/LICENSE-2.0", "http://opensource.org/licenses/ECL-2.0"), ""),
        (GNU % ("This program", ":", "", ",", "3"), "GPL-3.0-or-later"), (GNU % ("This program", ";", "", ";", "2"), "GPL-2.0-or-later"), (GNU % ("Foo", ":", "", ",", "3"), "GPL-3.0-or-later"),
        (GNU % ("This library", ";", "Lesser ", ";", "2.1"), "LGPL-2.1-or-later"), (GNU % ("This program", ":", "Affero ", ",", "3"), "AGPL-3.0-or-later"), (GNU % ("This program", ":", "", ",", "4"), ""),
        (GNU % ("A", ";", "", ";", "2") + GNU % ("B", ":", "Lesser ", ";", "3"), "GPL-2.0-or-later,LGPL-3.0-or-later"), (MPL, "MPL-2.0"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-NC-ND-4.0"), ("Licensed under CC BY-ND 4.0", "CC-BY-ND-4.0"),
        ("Released under the MIT License\nwithout end\n\n" + MPL, "MPL-2.0,MIT"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(df).collect()}
    assert [(cases[i][0], got[i]) for i in range(len(cases))] == cases
    same_as_sql(df)


def test_notices_as_they_are_written(spark):
    """Each notice with its own value: titles, short names, tails, subjects, lists, holders, heads of whole texts."""
    google = NAMES.replace("the copyright holder nor the names of its\n   contributors", "Google Inc. nor the names of its\n   contributors").replace("Google Inc.", "Google Inc")
    cases = [
        ("MIT License\n\nCopyright (c) 2020 X", "MIT"), ("BSD 3-Clause License", "BSD-3-Clause"), ("# The Unlicense\n", "Unlicense"),
        ("                                 Apache License\n                           Version 2.0, January 2004\n", "Apache-2.0"), ("GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n", "GPL-3.0"),
        ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "LGPL-3.0"), ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "AGPL-3.0"), ("GNU General Public License\nVersion 4", ""),
        ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"), ("It is licensed under the MIT License - see the [LICENSE](LICENSE.md) file for details", "MIT"), ("Foo bar is released under the terms and conditions of the ISC License.", "ISC"),
        ("Licensed under MIT.", "MIT"), ("Licensed under GPLv3.", "GPL-3.0"), ("Licensed under GPLv3+.", "GPL-3.0-or-later"), ("Licensed under the GNU General Public License v3.0 or later.", "GPL-3.0-or-later"), ("X is licensed under the GNU GPL version 2 or (at your option) any later version.", "GPL-2.0-or-later"),
        ("Licensed under the MIT License or the Apache License, Version 2.0.", "MIT,Apache-2.0"), ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "MIT,Apache-2.0"),
        ("SPDX-License-Identifier: Zlib", "Zlib"), ("Boost Software License - Version 1.0 - August 17th, 2003", "BSL-1.0"), ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
        (BSD + google, "BSD-3-Clause"), (BSD + NAMES.replace("Neither", "The").replace("nor the names of its\n   contributors may", "may not").replace("The the", "The"), "BSD-3-Clause"), (BSD, "BSD-2-Clause"),
        ("If it is licensed under the MIT License, ask.", ""), ("This is not licensed under the MIT License.", ""), ("We like the MIT License a lot.", ""), ("Licensed under mitigation rules.", ""),
        ("SPDX-License-Identifier: MIT OR (ISC AND Zlib) OR CC0-1.0 and on", "MIT,ISC,CC0-1.0,Zlib"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(df).collect()}
    told = [(cases[i][0], set(got[i].split(","))) for i in range(len(cases))]
    assert told == [(t, set(x.split(","))) for t, x in cases]
    same_as_sql(df)


def test_licenses_of_long_and_repeated_texts(spark):
    """A text of some megabytes in one line and in many, rows that stand twice, and ties of both readings."""
    long = "words and more words " * 150_000
    cases = [long + ". Licensed under MIT. " + long, "x\n" * 500_000 + MIT, MIT, MIT, "Licensed under MIT.", "Licensed under MIT."]
    df = spark.createDataFrame([(min(i, 4), t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_sentences, r.licenses) for r in licenses.scan(df).collect())
    assert got == [(0, 1, "MIT"), (1, 2, "MIT"), (2, 2, "MIT"), (3, 2, "MIT"), (4, 1, "MIT"), (4, 1, "MIT")]
