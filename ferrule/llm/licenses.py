"""Licence recognition by sentences and ordered rules.

A text is cut into sentences and these are normalised: A-Z to lower case, all else but letters and digits to blanks.
A normalised sentence that is known has an identifier, and a text is then the sequence of its identifiers.  A rule is
an ordered sequence of identifiers; it holds where the text's sequence has it in one piece, sentences that are not
known apart.  Sentences end at full stops, colons, question and exclamation marks before white space, but not at the colon
within a known sentence, and are taken twice: with a line's end as an end too, and with wrapped lines joined up to a
blank line, a heading, a copyright line or an address at a line's end.  A rule may hold in either sequence.

All of it is built-in expressions over each row alone; only texts with one of the ANCHORS, of which every known
sentence has one, are cut into sentences.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence notices, each with its identifier.
SENTENCES = {
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "apache-1": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-2": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2s": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache-3": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-4": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-line": "Released under the MIT License.",
    "mit-line2": "Licensed under the MIT License.",
    "mit-1": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-2": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-3": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-1": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-3": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-4": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-1": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-2": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-3": "See the GNU General Public License for more details.",
    "agpl-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3": "See the GNU Affero General Public License for more details.",
    "lgpl21-1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-3": "See the GNU Lesser General Public License for more details.",
    "mpl-1": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl-2": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-2s": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-2": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "bsd-5": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "zlib-1": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-2": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-3": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-1": "Distributed under the Boost Software License, Version 1.0.",
    "epl-1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "unlicense-1": "This is free and unencumbered software released into the public domain.",
    "ccbync4-line": "Licensed under CC BY-NC 4.0.",
    "ccby4-line": "Licensed under CC BY 4.0.",
    "ccbysa4-line": "Licensed under CC BY-SA 4.0.",
    "ccby4-1": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbync4-1": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0-1": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "reserved": "All rights reserved.",
}
# Rules, each a licence and the identifiers in their order.
RULES = (
    ("Apache-2.0", ("apache-line",)),
    ("Apache-2.0", ("apache-1", "apache-2", "apache-3", "apache-4")),
    ("Apache-2.0", ("apache-1", "apache-2s", "apache-3", "apache-4")),
    ("Apache-2.0", ("apache-1", "apache-3", "apache-4")),
    ("MIT", ("mit-line",)),
    ("MIT", ("mit-line2",)),
    ("MIT", ("mit-1", "mit-2", "mit-3")),
    ("BSD-2-Clause", ("bsd-1", "bsd-2", "bsd-3")),
    ("BSD-3-Clause", ("bsd-1", "bsd-2", "bsd-3", "bsd-4")),
    ("GPL-3.0", ("gpl3-line",)),
    ("GPL-3.0-or-later", ("gpl-1", "gpl-2", "gpl-3")),
    ("GPL-2.0-or-later", ("gpl2-1", "gpl-2", "gpl-3")),
    ("AGPL-3.0-or-later", ("agpl-1", "gpl-2", "agpl-3")),
    ("LGPL-2.1-or-later", ("lgpl21-1", "lgpl-2", "lgpl-3")),
    ("LGPL-3.0-or-later", ("lgpl3-1", "gpl-2", "lgpl-3")),
    ("Zlib", ("zlib-1", "zlib-2", "zlib-3")),
    ("BSL-1.0", ("boost-1",)),
    ("EPL-2.0", ("epl-1",)),
    ("MPL-2.0", ("mpl-1", "mpl-2")),
    ("MPL-2.0", ("mpl-1", "mpl-2s")),
    ("ISC", ("isc-1",)),
    ("Unlicense", ("unlicense-1",)),
    ("CC-BY-NC-4.0", ("ccbync4-line",)),
    ("CC-BY-NC-4.0", ("ccbync4-1",)),
    ("CC-BY-4.0", ("ccby4-line",)),
    ("CC-BY-4.0", ("ccby4-1",)),
    ("CC-BY-SA-4.0", ("ccbysa4-line",)),
    ("CC0-1.0", ("cc0-1",)),
    ("all-rights-reserved", ("reserved",)),
)
ANCHORS = "licen[sc]|copyright|rights reserved|redistribution|warrant|free software|unencumbered software|copy of the mpl|permission|held liable".replace(" ", r"[\s#*;/-]+")
#: What ends a sentence, before white space.
STOPS = r"([.!?]|:(?![\s#*;/-]+(?i:you[\s#*;/-]+can[\s#*;/-]+redistribute)))[ \t\n\r]+"
#: The address in the middle of an Apache notice, which has no stop behind it.
ADDRESS = r"(?i)(https?://[^\s]+)[\s#*;/-]+(?=unless[\s#*;/-]+required)"
_MARK = r"(?:[ \t]|[#*;]|//|--)*"
#: Lines that stand for themselves where wrapped lines are joined, and blank ones but for those before an address.
ALONE = (
    rf"(?im)^({_MARK}(?:copyright[ \t]+(?:\([c©]\)|©|[0-9])|©|\(c\)[ \t]).*)$",
    rf"(?im)^({_MARK}(?:the[ \t]+)?(?:mit|isc|apache|(?:[23]-clause[ \t]+)?bsd(?:[ \t]+[23]-clause)?)[ \t]+licen[sc]e(?:,?[ \t]+version[ \t]+[0-9.]+)?(?:[ \t]*\([^)\n]*\))?[ \t]*)$",
    r"(?im)(https?://[^\s]+[ \t]*)$",
)
BLANK = rf"(\r?\n){_MARK}\r?\n(?!(?:[ \t\r\n]|[#*;]|//|--)*https?://)"
#: The longer rule of each pair takes the place of the shorter where both hold.
WIDER = {"BSD-2-Clause": "BSD-3-Clause"}


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in sentence)).strip()


KNOWN = {normal(s): i for i, s in SENTENCES.items()}


def _sequence(text: Column, end: str) -> Column:
    """The identifiers of the known sentences, in order; sentences end at ``end``."""
    text = F.regexp_replace(text, ADDRESS, "$1\u0000")
    if end == "(?!)":
        for line in ALONE:
            text = F.regexp_replace(text, line, "$1\u0000")
        text = F.regexp_replace(text, BLANK, "\u0000\n")
    cut = F.split(F.regexp_replace(F.regexp_replace(text, end, "\n"), STOPS, "$1\u0000"), "\u0000" if end == "(?!)" else "[\u0000\n]")
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    ids = F.transform(cut, lambda s: F.element_at(known, F.trim(F.regexp_replace(F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "))))
    return F.filter(ids, lambda i: i.isNotNull())


def recognise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs, with ``sentence_ids`` and ``license_ids``, both arrays of strings, in place of columns of
    these names that docs has.

    sentence_ids is the longer of the two sequences of known sentences (that by lines if both are as long);
    license_ids has the licences of all rules that hold, in order.  Both are empty for null and empty texts and where
    nothing is known.  Rows stand for themselves, so repeated rows and an empty table need no care.
    """
    text = F.col(text_col).cast("string")
    some = text.rlike(f"(?i){ANCHORS}")
    none = F.array().cast("array<string>")
    # one column of docs' own fields and one of the sequences, so that no name of docs' is in the way
    sequences = [F.when(some, _sequence(text, end)).otherwise(none) for end in ("[\n\r]+", "(?!)")]
    rows = docs.select(F.struct(*docs.columns).alias("docs"), *(x.alias(c) for x, c in zip(sequences, ("by_line", "joined"), strict=True)))
    told = [F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" ")) for c in ("by_line", "joined")]
    by_license: dict[str, list[tuple[str, ...]]] = {}
    for name, ids in RULES:
        by_license.setdefault(name, []).append(ids)

    def holds(name: str) -> Column:
        out = F.lit(False)
        for ids in by_license[name]:
            for sequence in told:
                out = out | sequence.contains(f" {' '.join(ids)} ")
        return out

    found = [F.when(holds(n) & ~holds(WIDER[n]) if n in WIDER else holds(n), F.lit(n)) for n in sorted(by_license)]
    ids = F.when(F.size("by_line") + F.size("joined") > 0, F.filter(F.array(*found), lambda x: x.isNotNull())).otherwise(none)
    longer = F.when(F.size("joined") > F.size("by_line"), F.col("joined")).otherwise(F.col("by_line"))
    names = [c for c in docs.columns if c not in ("sentence_ids", "license_ids")]
    return rows.select(*(F.col("docs")[c].alias(c) for c in names), longer.alias("sentence_ids"), ids.alias("license_ids"))
