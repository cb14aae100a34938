"""Every rule on its notice, on one line, wrapped, and as a comment."""

import textwrap

import pytest

from ferrule.llm import licenses

HEAD = {"MIT": "MIT License\n\nCopyright (c) 2020 Some One\n\n", "ISC": "ISC License\n\nCopyright (c) 2020, Some One\n\n", "Apache-2.0": "Copyright 2020 Some One\n\n"}
URL = "http://www.apache.org/licenses/LICENSE-2.0"


def notice(ids, width, blank):
    parts = []
    for i in ids:
        s = licenses.SENTENCES[i]
        if i in ("apache-2", "apache-2s") and blank == "\n\n":
            s, url = s.rsplit(" ", 1)
            parts.append(textwrap.fill(s, width, break_long_words=False, break_on_hyphens=False) + f"\n\n    {url}")
        else:
            parts.append(textwrap.fill(s, width, break_long_words=False, break_on_hyphens=False))
    return blank.join(parts)


@pytest.fixture(scope="module")
def found(spark):
    rows, want = [], []
    for name, ids in licenses.RULES:
        for text in (notice(ids, 10**6, " "), HEAD.get(name, "Copyright (c) 2020 Some One\n") + notice(ids, 70, "\n\n"), HEAD.get(name, "").replace("\n\n", "\n") + notice(ids, 30, "\n\n")):
            for t in (text, textwrap.indent(text, "# ", lambda line: True), textwrap.indent(text, " * ", lambda line: True)):
                rows.append((len(rows), t))
                want.append((name, ids, t))
    got = {r.i: r for r in licenses.recognise(spark.createDataFrame(rows, "i int, text string")).collect()}
    return [(got[i], *w) for i, w in enumerate(want)]


def test_every_rule_holds_however_its_notice_is_laid_out(found):
    assert [(name, t) for r, name, _, t in found if name not in r.license_ids] == []


def test_all_sentences_are_known(found):
    assert [(ids, r.sentence_ids, t) for r, _, ids, t in found if not {*ids} <= {*r.sentence_ids}] == []


def test_columns_of_any_name(spark):
    rows = [("Released under the MIT License.", "mine", "a", ["x"])]
    out = licenses.recognise(spark.createDataFrame(rows, "text string, `__lines` string, joined string, license_ids array<string>"))
    assert sorted(out.columns) == ["__lines", "joined", "license_ids", "sentence_ids", "text"]
    row = out.first()
    assert (row["__lines"], row.joined, row.license_ids, row.sentence_ids) == ("mine", "a", ["MIT"], ["mit-line"])


def test_more_notices(spark):
    warranty = "but WITHOUT ANY WARRANTY; without even the implied\nwarranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    notices = {
        "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n"
        f"(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\n{warranty}  See the\nGNU Affero General Public License for more details.",
        "LGPL-2.1-or-later": "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 2.1 of the License, or (at your option) any later version.\n#\n"
        "# This library is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU\n# Lesser General Public License for more details.",
        "Zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\n"
        "including commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin must not be misrepresented.",
        "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)",
        "EPL-2.0": "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/\n\nMore text here.",
    }
    rows = spark.createDataFrame(list(notices.items()), "name string, text string")
    assert {r.name: r.license_ids for r in licenses.recognise(rows).collect()} == {n: [n] for n in notices}
