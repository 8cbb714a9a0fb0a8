"""Licence scans by sentences and rules.

A text is cut into sentences where a stop, colon or semicolon stands before white
space, at empty lines and at table bars; single line ends and comment marks are
blanks, so wrapped and commented texts read like plain ones. Sentences are
normalised (lower case, runs of anything but letters and digits become one blank)
and known ones mapped to identifiers. A known sentence that its own punctuation
cuts is the sequence of its pieces; a piece alone is nothing. A known sentence of
``LONG`` words or more may follow other words, such as a title without a stop. A licence rule is an
ordered list of identifiers; it matches where the list occurs as a run in the
text's sequence of known identifiers (unknown sentences between them do not break
a run, other known ones do). A matching rule whose list lies inside the list of
another matching rule is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sievework.llm.common import arrow_rows, pick, slices

_GNU = "as published by the Free Software Foundation"
_LATER = "or (at your option) any later version"

# fixed values: licence sentences by identifier; <> stands for any words
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-ref": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of <> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-licensor": "Neither the name of <> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission from the licensor",
    "bsd-advertise": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "apache-ref": "Licensed under the Apache License, Version 2.0",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3",
    "gpl-grant": f"you can redistribute it and/or modify it under the terms of the GNU General Public License {_GNU}, either version 3 of the License, {_LATER}",
    "gpl2-grant": f"you can redistribute it and/or modify it under the terms of the GNU General Public License {_GNU}; either version 2 of the License, {_LATER}",
    "gpl2-only": f"you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 {_GNU}",
    "lgpl21-grant": f"you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License {_GNU}; either version 2.1 of the License, {_LATER}",
    "lgpl3-grant": f"you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License {_GNU}, either version 3 of the License, {_LATER}",
    "agpl3-grant": f"you can redistribute it and/or modify it under the terms of the GNU Affero General Public License {_GNU}, either version 3 of the License, {_LATER}",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "mpl-ref": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at <>",
    "epl-ref": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at <>",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "zero-bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "cc0-ref": "To the extent possible under law, <> has waived all copyright and related or neighboring rights to <>",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-ref": "Licensed under CC BY 4.0",
    "cc-by-sa-ref": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-ref": "Licensed under CC BY-NC 4.0",
}
# fixed values: ordered rules
RULES = {
    "MIT": [["mit-grant", "mit-notice"], ["mit-ref"], ["mit-licensed"]],
    "ISC": [["isc-grant"]],
    "0BSD": [["zero-bsd-grant"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"], ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-licensor"]],
    "BSD-4-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse"]],
    "BSL-1.0": [["bsl-grant"]],
    "Zlib": [["zlib-warranty", "zlib-liable", "zlib-grant"]],
    "Unlicense": [["unlicense-free", "unlicense-grant"]],
    "Apache-2.0": [["apache-ref"], ["apache-header", "apache-use", "apache-copy"], ["apache-header", "apache-use"]],
    "GPL-2.0": [["gpl2-only"]],
    "GPL-2.0-or-later": [["gpl2-grant", "gpl-warranty"], ["gpl2-grant"]],
    "GPL-3.0": [["gpl3-ref"]],
    "GPL-3.0-or-later": [["gpl-grant", "gpl-warranty"], ["gpl-grant"]],
    "LGPL-2.1-or-later": [["lgpl21-grant"]],
    "LGPL-3.0-or-later": [["lgpl3-grant"]],
    "AGPL-3.0-or-later": [["agpl3-grant"]],
    "MPL-2.0": [["mpl-ref", "mpl-copy"], ["mpl-ref"]],
    "EPL-2.0": [["epl-ref"]],
    "CC0-1.0": [["cc0-ref"]],
    "CC-BY-4.0": [["cc-by-ref"], ["cc-by-work"]],
    "CC-BY-SA-4.0": [["cc-by-sa-ref"], ["cc-by-sa-work"]],
    "CC-BY-NC-4.0": [["cc-by-nc-ref"], ["cc-by-nc-work"]],
}
# A line "SPDX-License-Identifier: X" is a sentence and a rule of its own for every licence.
SENTENCES |= {f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}" for x in RULES}
for _name, _lists in RULES.items():
    _lists.append([f"spdx-{_name.lower()}"])

WORD = re.compile("[0-9A-Za-z]+")
# Between two words: a stop before white space, on the first word's line; an
# empty line; a table bar.
STOP = re.compile(r"""\A[^\n]*[.!?;:]["')\]]*[ \t\r\n]|\n[^0-9A-Za-z]*\n|\|""")
SPDX = re.compile("(SPDX-License-Identifier:[^\\n]*)\\n")
TAIL = re.compile(r"[^\s0-9A-Za-z|]*")
NUMBERED = re.compile("[0-9]{1,2}|[A-Za-z]")
LONG = 12


def pieces(text: str) -> list[tuple[str, int, int]]:
    """(normalised sentence, start, end) of all sentences. A number or letter
    before a bracket and white space, as in lists, is a sentence of its own."""
    out: list[tuple[str, int, int]] = []
    held: list[str] = []
    start = end = 0
    # An identifier line ends with its line.
    text = SPDX.sub(r"\1|", text)
    for m in WORD.finditer(text):
        if held:
            gap = text[end : m.start()]
            listed = gap[0] == ")" and gap[1:2] in (" ", "\t", "\r", "\n") and len(held) == 1 and NUMBERED.fullmatch(text[start:end])
            if listed or STOP.search(gap):
                out.append((" ".join(held), start, end))
                held = []
        if not held:
            start = m.start()
        held.append(m[0].lower())
        end = m.end()
    if held:
        out.append((" ".join(held), start, end))
    return out


class Known:
    """Known sentences by their first piece, longest first; a piece with a gap is
    compared by the words before and after it."""

    def __init__(self, sentences: dict[str, str]):
        self.by_first: dict[str, list] = {}
        self.by_last_words: dict[str, list] = {}
        self.open: list = []
        hints = set()
        for name, s in sentences.items():
            parts = [p[0] for p in pieces(s.replace("<>", " GAPGAP "))]
            hints.add(max((w for p in parts for w in p.split() if w != "gapgap"), key=len))
            shape = [tuple(x.strip(" ") for x in p.split("gapgap")) if "gapgap" in p else p for p in parts]
            (self.open if isinstance(shape[0], tuple) else self.by_first.setdefault(shape[0], [])).append((name, shape))
            if isinstance(shape[0], str) and sum(len(p.split()) for p in parts) >= LONG:
                self.by_last_words.setdefault(self._tail(shape[0]), []).append((name, shape))
        for own in [*self.by_first.values(), *self.by_last_words.values(), self.open]:
            own.sort(key=lambda x: -len(x[1]))
        # Every known sentence holds one of these words, so a text without them has none.
        self.hint = re.compile("|".join(sorted(hints)), re.I)

    @staticmethod
    def _tail(piece: str) -> str:
        return " ".join(piece.rsplit(" ", 3)[-3:])

    @staticmethod
    def _fits(shape, piece: str) -> bool:
        if isinstance(shape, str):
            return shape == piece
        at = 0
        for i, part in enumerate(shape):
            if part and i == 0:
                if not piece.startswith(part + " "):
                    return False
                at = len(part)
            elif part and i == len(shape) - 1:
                return piece.endswith(" " + part) and len(piece) - len(part) - 1 >= at
            elif part:
                at = piece.find(f" {part} ", at)
                if at < 0:
                    return False
                at += len(part) + 1
        return True

    def at(self, found: list, i: int) -> tuple[str, int, int] | None:
        """(identifier, pieces, words before it) of the longest known sentence that
        starts in piece i, first of all at its start."""

        def rest(shape) -> bool:
            return len(shape) <= len(found) - i and all(self._fits(s, found[i + k][0]) for k, s in enumerate(shape) if k)

        piece = found[i][0]
        for name, shape in [*self.by_first.get(piece, []), *self.open]:
            if self._fits(shape[0], piece) and rest(shape):
                return name, len(shape), 0
        for name, shape in self.by_last_words.get(self._tail(piece), []):
            if piece.endswith(" " + shape[0]) and rest(shape):
                return name, len(shape), piece[: -len(shape[0])].count(" ")
        return None


def found_sentences(text: str | None, known: Known) -> list[tuple[str, int, int]]:
    """(identifier, start, end) of the known sentences, in text order."""
    out = []
    if not text or not known.hint.search(text):
        return out
    found, i = pieces(text), 0
    while i < len(found):
        hit = known.at(found, i)
        if hit:
            start = found[i][1]
            if hit[2]:
                start = next(m.start() for k, m in enumerate(WORD.finditer(text, start)) if k == hit[2])
            # Marks right behind the last word belong to the sentence.
            out.append((hit[0], start, TAIL.match(text, found[i + hit[1] - 1][2]).end()))
        i += hit[1] if hit else 1
    return out


def matched(ids: list[str], rules: dict[str, list[list[str]]]) -> list[str]:
    """Licences whose rules match a sequence of identifiers, sorted."""

    def inside(small: list[str], big: list[str]) -> bool:
        return any(big[i : i + len(small)] == small for i in range(len(big) - len(small) + 1))

    hit = [(name, r) for name, all_ in rules.items() for r in all_ if inside(r, ids)]
    return sorted({name for name, r in hit if not any(len(o) > len(r) and inside(r, o) for _, o in hit)})


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: dict[str, list[list[str]]] = RULES
) -> DataFrame:
    """(doc_id, n_known, sentences, licenses) of every row: known sentences as
    identifier:start:end in text order, licences sorted, both comma-joined.

    Null and empty texts and texts without a known sentence have none; repeated
    rows and null ids are scanned like any other; texts are scanned whole. Other
    columns are not read, whatever their names. ``sentences`` and ``rules`` may be
    extended or replaced; <> in a sentence stands for any words."""
    known = Known(sentences)
    out = "doc_id bigint, n_known bigint, sentences string, licenses string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                got = found_sentences(text, known)
                names = matched([g[0] for g in got], rules) if got else []
                rows.append((doc, len(got), ",".join(f"{n}:{s}:{e}" for n, s, e in got), ",".join(names)))
            yield arrow_rows(out, list(zip(*rows)))

    return pick(docs, id_col, text_col).mapInArrow(run, out)


# The same borders as text for SQL.
LISTED_SQL = r"(^|[^0-9A-Za-z])([0-9]{1,2}|[A-Za-z])\)([ \t\r\n])"
BORDER_SQL = r"""[.!?;:]["'')\]]*[ \t\r\n]|\||\n[^0-9A-Za-z]*\n"""


def _cut_sql(text: str) -> str:
    """Sentences of a text as a list, cut and normalised by SQL itself."""
    marked = f"regexp_replace({text}, '(SPDX-License-Identifier:[^\\n]*)\\n', '\\1|', 'g')"
    marked = f"regexp_replace({marked}, '\\n[^0-9A-Za-z\\n|]+', chr(10) || ' ', 'g')"
    marked = f"regexp_replace({marked}, '{LISTED_SQL}', '\\1\\2' || chr(1) || '\\3', 'g')"
    marked = f"regexp_replace({marked}, '{BORDER_SQL}', chr(1), 'g')"
    lower = "translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda p: trim(regexp_replace({lower}, '[^0-9a-z]+', ' ', 'g'), ' ')), lambda p: p <> '')"


def oracle(sentences: dict[str, str] = SENTENCES, rules: dict[str, list[list[str]]] = RULES) -> str:
    """DuckDB text of n_known and licences; the given sentences are cut by SQL."""
    quoted = lambda s: "'" + s.replace("'", "''").replace("<>", " gapgap ") + "'"
    given = ", ".join(f"('{name}', {quoted(s)})" for name, s in sentences.items())
    table = ", ".join(f"('{name}', {len(r)}, ',{','.join(r)},')" for name, all_ in rules.items() for r in all_)
    return rf"""
WITH given(id, s) AS (VALUES {given}), rules(license, n, ids) AS (VALUES {table}),
known AS MATERIALIZED (SELECT id, len(p) AS n, list_transform(p, lambda x: replace(x, ' gapgap', ' %')) AS p FROM (SELECT id, {_cut_sql('s')} AS p FROM given)),
docs AS (SELECT doc_id, {_cut_sql("coalesce(text, '')")} AS p FROM documents),
place AS (SELECT doc_id, i, p[i] AS first, p FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM docs)),
long AS (SELECT *, len(string_split(array_to_string(p, ' '), ' ')) >= {LONG} AND NOT contains(p[1], '%') AS long FROM known),
hit AS (SELECT doc_id, i, id, n FROM place JOIN long k ON place.first LIKE k.p[1] OR (k.long AND place.first LIKE '% ' || k.p[1]) WHERE len(list_filter(range(2, n + 1), lambda j: place.p[i + j - 1] LIKE k.p[j])) = n - 1
  QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY place.first LIKE k.p[1] DESC, n DESC, length(k.p[1]) DESC) = 1),
f AS (SELECT doc_id, count(*) AS n_known, ',' || string_agg(id, ',' ORDER BY i) || ',' AS ids FROM hit GROUP BY doc_id),
h AS (SELECT doc_id, license, r.n, r.ids FROM f JOIN rules r ON contains(f.ids, r.ids)),
k AS (SELECT DISTINCT doc_id, license FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.doc_id = h.doc_id AND o.n > h.n AND contains(o.ids, h.ids))),
l AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_known, 0)::BIGINT AS n_known, coalesce(licenses, '') AS licenses FROM documents LEFT JOIN f USING (doc_id) LEFT JOIN l USING (doc_id)
"""
