"""Licence scans: sentences become identifiers, and ordered rules match runs of identifiers.

A text is cut into sentences; each is normalised (case, punctuation, white space, common
spellings) and looked up among the known licence sentences. The identifiers found, in
order, are matched with the rules, longest first; up to ``GAP`` unknown sentences may
lie between two of a rule (a copyright line, a blank heading), but no known one: it
belongs to a rule of its own. Some known sentences have a slot for a name.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from foliolens.llm.common import map_batches, with_column, with_fields

#: Unknown sentences allowed between two neighbours of a rule.
GAP = 2

# Sentences of public licence texts and notices, by identifier.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit-ref": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "MIT License"),
    "apache-ref": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "Apache License, Version 2.0"),
    "gpl3-ref": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "GNU General Public License, version 3"),
    "gpl2-ref": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."),
    "lgpl3-ref": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "mpl2-ref": ("Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "ccbync4-ref": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "ccby4-ref": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "ccbysa4-ref": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."),
    "cc0-ref": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "bsd3-ref": ("Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."),
    "bsd2-ref": ("Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License."),
    "isc-ref": ("Licensed under the ISC License.", "Released under the ISC License."),
    "unlicense-domain": ("This is free and unencumbered software released into the public domain.",),
    "mit-grant": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "mit-warranty": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "isc-warranty": ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "bsd-names": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "apache-header": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',),
    "apache-copy": ("You may obtain a copy of the License at",),
    "apache-basis": ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',),
    "gpl-free": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "gpl2-free": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "gpl-hope": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",),
    "spdx-mit": ("SPDX-License-Identifier: MIT",),
    "spdx-apache": ("SPDX-License-Identifier: Apache-2.0",),
    "spdx-gpl3": ("SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0"),
    "spdx-bsd3": ("SPDX-License-Identifier: BSD-3-Clause",),
}

#: Words that a slot takes at most.
SLOT_WORDS = 12

# Known sentences with a slot (...) for the name of a work or of a holder, by identifier.
SLOTTED: tuple[tuple[str, str], ...] = (
    ("bsd-names", "Neither the name of ... nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-names", "The name of ... may not be used to endorse or promote products derived from this software without specific prior written permission."),
    ("mit-ref", "... licensed under the MIT License."),
    ("mit-ref", "... released under the MIT License."),
    ("mit-ref", "... distributed under the MIT License."),
    ("mit-ref", "... available under the MIT License."),
    ("mit-ref", "... licensed under the terms of the MIT License."),
    ("mit-ref", "... released under the terms of the MIT License."),
    ("mit-ref", "... distributed under the terms of the MIT License."),
    ("apache-ref", "... licensed under the Apache License, Version 2.0."),
    ("apache-ref", "... released under the Apache License, Version 2.0."),
    ("apache-ref", "... distributed under the Apache License, Version 2.0."),
    ("apache-ref", "... licensed under the terms of the Apache License, Version 2.0."),
    ("apache-ref", "... distributed under the terms of the Apache License, Version 2.0."),
    ("gpl3-ref", "... licensed under the GNU General Public License, version 3."),
    ("gpl3-ref", "... released under the GNU General Public License, version 3."),
    ("gpl3-ref", "... distributed under the terms of the GNU General Public License, version 3."),
    ("gpl2-ref", "... licensed under the GNU General Public License, version 2."),
    ("gpl2-ref", "... released under the GNU General Public License, version 2."),
    ("gpl2-ref", "... distributed under the terms of the GNU General Public License, version 2."),
    ("lgpl3-ref", "... licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl3-ref", "... released under the GNU Lesser General Public License, version 3."),
    ("mpl2-ref", "... licensed under the Mozilla Public License, version 2.0."),
    ("mpl2-ref", "... released under the Mozilla Public License, version 2.0."),
    ("bsd3-ref", "... licensed under the BSD 3-Clause License."),
    ("bsd3-ref", "... released under the BSD 3-Clause License."),
    ("bsd2-ref", "... licensed under the BSD 2-Clause License."),
    ("bsd2-ref", "... released under the BSD 2-Clause License."),
    ("isc-ref", "... licensed under the ISC License."),
    ("isc-ref", "... released under the ISC License."),
    ("ccby4-ref", "... licensed under CC BY 4.0."),
    ("ccbysa4-ref", "... licensed under CC BY-SA 4.0."),
    ("ccbync4-ref", "... licensed under CC BY-NC 4.0."),
)

# Ordered rules, the licence that a sequence of identifiers stands for.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("Apache-2.0", ("apache-header", "apache-copy", "apache-basis")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("Apache-2.0", ("apache-header",)),
    ("MIT", ("mit-grant",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense-domain",)),
    ("MIT", ("mit-ref",)),
    ("Apache-2.0", ("apache-ref",)),
    ("GPL-3.0", ("gpl3-ref",)),
    ("GPL-2.0", ("gpl2-ref",)),
    ("LGPL-3.0", ("lgpl3-ref",)),
    ("MPL-2.0", ("mpl2-ref",)),
    ("CC-BY-NC-4.0", ("ccbync4-ref",)),
    ("CC-BY-4.0", ("ccby4-ref",)),
    ("CC-BY-SA-4.0", ("ccbysa4-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("BSD-3-Clause", ("bsd3-ref",)),
    ("BSD-2-Clause", ("bsd2-ref",)),
    ("ISC", ("isc-ref",)),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("GPL-3.0", ("spdx-gpl3",)),
    ("BSD-3-Clause", ("spdx-bsd3",)),
)

#: Every known sentence holds one of these; texts without any need not be cut.
_HINT = re.compile(r"licen[sc]|permission|redistribut|without warrant|copyright|free software|public domain|cc0|merchantab", re.I)
#: A sentence ends at a line break or after . ! ? : and white space.
_SENTENCE = re.compile(r"[^\n]+")
_END = re.compile(r"(?<=[.!?:;])\s+")
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_SPELLINGS = {"licence": "license", "licenced": "licensed", "v": "version"}

Match = tuple[str, int, int, tuple[str, ...]]


def normalised(sentence: str) -> str:
    """Words in lower case without punctuation; version numbers stay whole."""
    return " ".join(_SPELLINGS.get(w, w) for w in _WORD.findall(sentence.lower()))


@cache
def _known() -> dict[str, str]:
    """Identifiers by normalised sentence."""
    return {normalised(s): key for key, texts in SENTENCES.items() for s in texts}


@cache
def _slotted(leading: bool) -> tuple[tuple[str, re.Pattern], ...]:
    """(identifier, pattern over normalised words) of the sentences whose slot comes first, or of the others."""
    found = []
    for key, sentence in SLOTTED:
        before, after = map(normalised, sentence.split("...", 1))
        if leading != bool(before):
            name = rf"(?:\S+ ){{{0 if leading else 1},{SLOT_WORDS}}}"
            found.append((key, re.compile(f"{re.escape(before)}{' ' if before else ''}{name}{re.escape(after)}")))
    return tuple(found)


def known_sentence(words: str, leading: bool) -> str | None:
    """The identifier of a normalised sentence; one that begins with a slot only if ``leading``."""
    found = _known().get(words)
    for kind in (False, True)[: 1 + leading] if found is None else ():
        found = found or next((key for key, pattern in _slotted(kind) if pattern.fullmatch(words)), None)
    return found


@cache
def _longest() -> int:
    return max(*map(len, _known()), *(len(normalised(s)) + 20 * SLOT_WORDS for _, s in SLOTTED))


#: The first line of a sentence that begins with a slot holds one of these.
_SUBJECT = re.compile(r"\b(?:licensed|released|distributed|available)\b")


def _pieces(text: str):
    for line in _SENTENCE.finditer(text):
        at = line.start()
        body = line[0]
        for m in _END.finditer(body):
            yield at, line.start() + m.start()
            at = line.start() + m.end()
        yield at, line.end()


def licence_sentences(text: str) -> list[tuple[str | None, int, int]]:
    """(identifier or None, start, end) of the sentences; wrapped and inner-stopped sentences are joined.

    A known sentence may be wrapped over lines or hold stops of its own, so from each
    piece as many are tried together as the longest known sentence can span, the longest
    known first. Pieces without words are none.
    """
    found = [(span, words) for span in _pieces(text) if (words := normalised(text[span[0] : span[1]]))]
    pieces, words = [x[0] for x in found], [x[1] for x in found]
    starts = _starts()
    out, i = [], 0
    while i < len(pieces):
        hit, leading = None, _SUBJECT.search(words[i]) is not None
        if leading or any(words[i].startswith(s) or s.startswith(words[i]) for s in starts.get(words[i].split(" ", 1)[0], ())):
            joined = ""
            for k in range(i, len(pieces)):
                joined = f"{joined} {words[k]}".strip()
                if len(joined) > _longest():
                    break
                if key := known_sentence(joined, leading):
                    hit = (key, k)
                leading = leading and text[pieces[k][1] - 1] not in ".!?:;"  # a slot bridges no end of a sentence
        if hit:
            out.append((hit[0], pieces[i][0], pieces[hit[1]][1]))
            i = hit[1] + 1
        else:
            out.append((None, *pieces[i]))
            i += 1
    return out


@cache
def _starts() -> dict[str, tuple[str, ...]]:
    """Known sentences, and what comes before a slot, by first word: a piece that begins none of them is passed over at once."""
    found: dict[str, list[str]] = {}
    for s in [*_known(), *(before for _, x in SLOTTED if (before := normalised(x.split("...", 1)[0])))]:
        found.setdefault(s.split(" ", 1)[0], []).append(s)
    return {k: tuple(v) for k, v in found.items()}


def match_rules(row: list[str | None]) -> list[tuple[str, int, int, tuple[str, ...]]]:
    """(licence, first, last, identifiers) of the rules matched in a row of identifiers, leftmost, the longest rule first.

    Matches don't overlap. Only unknown sentences (None) may lie between two of a rule, ``GAP`` at most.
    """
    found, i = [], 0
    while i < len(row):
        for licence, wanted in _rules_from(row[i]):
            at, k, gap = i, 0, 0
            while at < len(row) and k < len(wanted):
                if row[at] == wanted[k]:
                    k, gap = k + 1, 0
                elif row[at] is None and gap < GAP:
                    gap += 1
                else:
                    break
                at += 1
            if k == len(wanted):
                found.append((licence, i, at - 1, wanted))
                i = at - 1
                break
        i += 1
    return found


@cache
def _rules_from(first: str | None) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """The rules that begin with an identifier, the longest first."""
    return tuple(sorted((r for r in RULES if r[1][0] == first), key=lambda r: -len(r[1])))


def find_licences(text: str | None) -> list[Match]:
    """(licence, start, end, identifiers) of every rule matched in a whole text, as in ``match_rules``.

    Null, empty and unlicensed texts have none.
    """
    if not text or not _HINT.search(text):
        return []
    row = licence_sentences(text)
    return [(licence, row[a][1], row[b][2], wanted) for licence, a, b, wanted in match_rules([x[0] for x in row])]


def scan_licences(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``licences``, an array of (licence, start, end, sentences), to each row; one of that name is replaced.

    Null and empty texts get an empty array, rows that repeat each their own, texts of any length are read whole.
    """
    out = docs.drop("licences")
    kind = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("sentences", pa.list_(pa.string()))]))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        rows = [[{"licence": n, "start": a, "end": b, "sentences": list(s)} for n, a, b, s in find_licences(t)] for t in texts]
        return with_column(batch, "licences", pa.array(rows, kind))

    return map_batches(out, scan, with_fields(out.schema, ("licences", "array<struct<licence:string,start:bigint,end:bigint,sentences:array<string>>>")))
