import textwrap

import duckdb
import pytest

from sievework.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""
BSD3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD2 = BSD3.split("\n\n3. ")[0]
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS."""
GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY."""
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
LGPL21 = GPL2.replace("program", "library").replace("General Public", "Lesser General Public").replace("version 2 ", "version 2.1 ")
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
TEXTS = {"MIT": MIT, "BSD-3-Clause": BSD3, "BSD-2-Clause": BSD2, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL2, "LGPL-2.1-or-later": LGPL21, "MPL-2.0": MPL, "ISC": ISC, "Zlib": ZLIB}


def wrapped(text, mark, width=72):
    lines = []
    for block in text.split("\n\n"):
        lines += textwrap.wrap(" ".join(block.split()), width) + [""]
    return "\n".join((mark + line).rstrip() for line in lines[:-1])


def forms():
    for name, text in TEXTS.items():
        yield name, text
        for mark in ("", "# ", "// ", " * ", "    ", "; ", "> "):
            yield name, "Copyright (c) 2020 Some One\n" + mark.rstrip() + "\n" + wrapped(text, mark)
        yield name, "/*\n" + wrapped(text, " * ", 60) + "\n */\nint main() { return 0; }\n"
        yield name, wrapped(text, "").replace("\n", "\r\n")
        yield name, "A title. " + " ".join(text.split())
    yield "MIT", "The usual license\n" + wrapped(MIT, "")
    yield "", "This is not released under the MIT license"
    yield "MIT", "// SPDX-License-Identifier: MIT\nint x;"
    yield "BSD-3-Clause,MIT", wrapped(MIT, "# ") + "\n#\n" + wrapped(BSD3, "# ")
    yield "BSD-3-Clause", BSD3.replace("the copyright holder", "the University of Somewhere")
    yield "BSD-3-Clause", BSD3 + " from the licensor."
    yield "BSD-2-Clause", BSD2.replace("1. ", "(a) ").replace("2. ", "b) ")
    for nothing in ("2.0", "Release notes. v. 2.0", "| 2.0 | Version: 2.0 |", "See the License, version 2.0. 2.0. v. 2.0", "", "This program is free software: really", "Neither the name of", "mit license", "the License at"):
        yield "", nothing


def test_real_texts(spark):
    rows = [(i, t, n, "x", "y") for i, (n, t) in enumerate(forms())] + [(None, MIT, "MIT", "x", "y"), (-1, None, "", "x", "y"), (0, TEXTS["MIT"], "MIT", "x", "y"), (-2, "word " * 200_000 + MIT, "MIT", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, want string, n_known string, licenses string")
    got = licenses.scan_licenses(df).collect()
    want = sorted((str(r[0]), r[2]) for r in rows)
    assert [x for x in sorted((str(r.doc_id), r.licenses) for r in got) if x not in want] == []
    assert len(got) == len(rows) and licenses.scan_licenses(df.limit(0)).collect() == []


def test_sql_twin_on_real_texts():
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    rows = [(i, t) for i, (_, t) in enumerate(forms())]
    con.executemany("insert into documents values (?, ?)", rows)
    got = {r[0]: (r[1], r[2]) for r in con.execute(licenses.oracle()).fetchall()}
    known = licenses.Known(licenses.SENTENCES)
    for i, text in rows:
        ids = [x[0] for x in licenses.found_sentences(text, known)]
        assert got[i] == (len(ids), ",".join(licenses.matched(ids, licenses.RULES))), text


def test_offsets_lead_back_to_the_text():
    known = licenses.Known(licenses.SENTENCES)
    text = "é " + wrapped(MPL, "// ")
    (name, s, e), *rest = licenses.found_sentences(text, known)
    assert name == "mpl-ref" and text[s:e].startswith("This Source") and text[s:e].endswith("2.0.") and [x[0] for x in rest] == ["mpl-copy"]


@pytest.mark.parametrize("sentence", ["Anyone may copy this. Really.", "Owned by <> and no one else"])
def test_callers_extend_the_table(spark, sentence):
    rows = [(1, "Yes. " + sentence.replace("<>", "a few people"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = licenses.scan_licenses(df, sentences=licenses.SENTENCES | {"own": sentence}, rules=licenses.RULES | {"Own": [["own"]]}).first()
    assert (got.n_known, got.licenses) == (1, "Own")
