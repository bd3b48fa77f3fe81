"""Licence scans by sentence rules.

Texts are cut into sentences (at line ends, and over wrapped lines at sentence marks), which are normalised and looked up among
known licence sentences; from every line start and sentence start known ones are also matched word by word, over wraps, comment
marks and sentence marks inside them. A licence rule is an ordered list of sentence ids; it matches where its ids follow each other
with at most GAP unknown sentences between two of them. The longest rule that starts at a sentence wins. One pass over the rows,
without a shuffle.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import prepare

#: Unknown sentences that may lie between two of a rule.
GAP = 3

#: Known sentences by id.
SENTENCES: dict[str, str] = {
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "apache-you": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-short": "Licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "bsd-redist": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0": "This work is dedicated to the public domain under CC0 1.0.",
    "rights": "All rights reserved.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "gpl2-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2 of the License.",
    "gpl3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "lgpl21-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl3-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "epl2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "epl1": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at",
    "cddl": "The contents of this file are subject to the terms of the Common Development and Distribution License (the License).",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "bsl-short": "Distributed under the Boost Software License, Version 1.0.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "postgresql-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "ofl": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "artistic2": "This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License (2.0).",
    "mpl11": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    "afl3": "Licensed under the Academic Free License version 3.0",
    "eupl12": "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\");",
    "gfdl13": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation;",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nd-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: (licence, ordered sentence ids); several rules may name one licence.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache-short",)),
    ("Apache-2.0", ("apache-you",)),
    ("Apache-2.0", ("apache-you", "apache-copy", "apache-url", "apache-asis", "apache-see")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-3.0", ("gpl3-short",)),
    ("GPL-3.0", ("gpl-free", "gpl-hope", "gpl-see")),
    ("BSD-2-Clause", ("bsd-redist", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("CC0-1.0", ("cc0",)),
    ("MPL-2.0", ("mpl",)),
    ("all-rights-reserved", ("rights",)),
    ("GPL-2.0", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0", ("gpl2-only", "gpl-hope", "gpl-see")),
    ("GPL-3.0", ("gpl3-only", "gpl-hope", "gpl-see")),
    ("AGPL-3.0", ("agpl-free", "gpl-hope", "agpl-see")),
    ("LGPL-2.1", ("lgpl21-free", "lgpl-hope", "lgpl-see")),
    ("LGPL-3.0", ("lgpl3-free", "lgpl-hope", "lgpl-see")),
    ("LGPL-3.0", ("lgpl3-program", "gpl-hope", "lgpl-see")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-and",)),
    ("Unlicense", ("unlicense-free",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("EPL-2.0", ("epl2",)),
    ("EPL-1.0", ("epl1",)),
    ("CDDL-1.0", ("cddl",)),
    ("Zlib", ("zlib-asis", "zlib-grant")),
    ("BSL-1.0", ("bsl",)),
    ("BSL-1.0", ("bsl-short",)),
    ("0BSD", ("0bsd-grant",)),
    ("MIT-0", ("mit0-grant",)),
    ("PostgreSQL", ("postgresql-grant",)),
    ("WTFPL", ("wtfpl",)),
    ("OFL-1.1", ("ofl",)),
    ("Artistic-2.0", ("artistic2",)),
    ("MPL-1.1", ("mpl11",)),
    ("AFL-3.0", ("afl3",)),
    ("EUPL-1.2", ("eupl12",)),
    ("GFDL-1.3", ("gfdl13",)),
    ("BSD-4-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-advert")),
    ("BSD-4-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse")),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-work",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-work",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-work",)),
)

#: Identifiers of the SPDX list that are known in tags (fixed values).
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC0-1.0 CDDL-1.0 "
    "EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later "
    "MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OpenSSL PostgreSQL Python-2.0 Ruby Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib"
).split()
SENTENCES |= {f"spdx-{x}": f"SPDX-License-Identifier: {x}" for x in SPDX}
RULES += tuple((x, (f"spdx-{x}",)) for x in SPDX)

#: The header of files of the Apache Software Foundation.
SENTENCES |= {
    "asf-to": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    "asf-notice": "See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
    "asf-you": 'The ASF licenses this file to you under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
}
RULES += (
    ("Apache-2.0", ("asf-you",)),
    ("Apache-2.0", ("asf-you", "apache-copy", "apache-url", "apache-asis", "apache-see")),
    ("Apache-2.0", ("asf-to", "asf-notice", "asf-you", "apache-copy", "apache-url", "apache-asis", "apache-see")),
)

#: Licences often named together in one tag, and the names by which projects say theirs (fixed values).
JOINED = "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause GPL-2.0-only GPL-2.0-or-later GPL-3.0-or-later LGPL-2.1-or-later MPL-2.0 CC0-1.0".split()
NAMES = {
    "MIT": ("MIT",), "Apache-2.0": ("Apache 2.0", "Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0"), "BSD-2-Clause": ("BSD 2-Clause",), "BSD-3-Clause": ("BSD 3-Clause",), "ISC": ("ISC",),
    "GPL-2.0": ("GPLv2", "GNU GPLv2", "GNU General Public License v2.0"), "GPL-3.0": ("GPLv3", "GNU GPLv3", "GPL-3.0", "GNU General Public License v3.0"), "LGPL-3.0": ("LGPLv3", "GNU LGPLv3"), "AGPL-3.0": ("AGPLv3", "GNU AGPLv3"),
    "MPL-2.0": ("MPL 2.0", "Mozilla Public License 2.0"), "EPL-2.0": ("EPL 2.0", "Eclipse Public License 2.0"), "BSL-1.0": ("Boost Software License 1.0",), "Unlicense": ("Unlicense",), "Zlib": ("zlib",), "WTFPL": ("WTFPL",),
}
_SAID = ("This project is licensed under the {}", "This software is licensed under the {}", "Licensed under the {}", "Released under the {}", "Distributed under the {}")
_MORE = ("", " - see the LICENSE file for details", " - see the LICENSE.md file for details")


def _said() -> dict[str, tuple[str, str]]:
    """Further sentences, each with its id and licence: two licences in a tag, and what projects say of theirs."""
    out = {f"SPDX-License-Identifier: {a} {word} {b}": (f"spdx-{a}-{word.lower()}-{b}", f"{a} {word} {b}") for a in JOINED for b in JOINED if a != b for word in ("OR", "AND")}
    for licence, names in NAMES.items():
        for k, name in enumerate(names):
            for i, text in enumerate(_SAID):
                for j, more in enumerate(_MORE):
                    for n, kind in enumerate(("", " license") if "icense" not in name else ("",)):
                        out[text.format(name) + kind + more] = (f"said-{licence}-{k}{i}{j}{n}", licence)
    return out


def _add_said() -> None:
    global RULES
    taken = {normalised(x) for x in SENTENCES.values()}
    for sentence, (name, licence) in _said().items():
        if (plain := normalised(sentence)) not in taken:
            taken.add(plain)
            SENTENCES[name] = sentence
            RULES += ((licence, (name,)),)

_PLAIN = re.compile(r"[^a-z0-9.]+")
_LINE = re.compile(r"[^\n]+")
_STOP = re.compile(r"(?<=[.!?:])\s++|\n[^\S\n]*+(?:[#*/;-]++[^\S\n]*+)?\n")


def normalised(sentence: str) -> str:
    return " ".join(w for w in (x.strip(".") for x in _PLAIN.sub(" ", sentence.lower()).split()) if w)


_add_said()


def known(sentences: dict[str, str]) -> dict[str, str]:
    out = {normalised(s): k for k, s in sentences.items()}
    if len(out) < len(sentences) or "" in out:
        raise ValueError("two known sentences are alike, or one is empty")
    return out


_GAP = re.compile(r"[^a-zA-Z0-9\n]*")
_FIRST = re.compile(r"[a-zA-Z0-9]++(?:\.[a-zA-Z0-9]++)*+")
_HEAD = re.compile(r"[^a-z0-9]*+([a-z0-9][a-z0-9.]*+)")


@functools.lru_cache(8)
def _by_first_word(table: tuple[tuple[str, str], ...]) -> dict[str, list[tuple[re.Pattern, str]]]:
    """(pattern, id) of the known sentences that begin with a word; a sentence ends where its line does or at a sentence mark."""
    out: dict[str, list[tuple[re.Pattern, str]]] = {}
    for sentence, name in table:
        words = "[^a-zA-Z0-9]+".join(re.escape(w) for w in sentence.split())
        pattern = re.compile(rf"[^a-zA-Z0-9\n]*?(?=[a-zA-Z0-9])({words})(?![a-zA-Z0-9]|\.[a-zA-Z0-9])(?:[^\sa-zA-Z0-9]*[.!?:;][^\sa-zA-Z0-9]*(?=\s|\Z)|[^\na-zA-Z0-9]*(?=\n|\Z))", re.IGNORECASE | re.ASCII)
        out.setdefault(sentence.split()[0], []).append((pattern, name))
    return out


@functools.lru_cache(8)
def _heads(sentences: tuple[str, ...]) -> frozenset[str]:
    """First words of the known sentences."""
    return frozenset(s.split()[0] for s in sentences)


def sentence_ids(text: str, table: dict[str, str]) -> list[tuple[int, int, str | None]]:
    """(start, end, id or None) of the text's sentences in order; where line and wrapped reading overlap, known ones win."""
    heads = _heads(tuple(table))
    found: dict[int, tuple[int, str]] = {}
    plain: list[tuple[int, int]] = []

    def put(start: int, end: int) -> str | None:
        part = text[start:end]
        lead = len(part) - len(part.lstrip())
        head = _HEAD.match(part.lower())
        name = table.get(normalised(part)) if head and head[1].rstrip(".") in heads else None
        if name is not None and found.get(start + lead, (0, ""))[0] < end:
            found[start + lead] = (end, name)
        return name

    starts: set[int] = set()
    for line in _LINE.finditer(text):
        at = line.start()
        starts.add(at)
        if put(at, line.end()) is not None:
            plain.append((at, line.end()))
            continue
        for stop in [*_STOP.finditer(line[0]), None]:
            end = line.start() + stop.start() if stop else line.end()
            put(at, end)
            plain.append((at, end))
            at = line.start() + stop.end() if stop else end
    at = 0
    for stop in [*_STOP.finditer(text), None]:
        end = stop.start() if stop else len(text)
        if "\n" in text[at:end]:
            put(at, end)
        at = stop.end() if stop else end
        starts.add(at)
    first_words = _by_first_word(tuple(table.items()))
    reach = -1
    for start in sorted(starts):
        if start <= reach:
            continue  # of starts before one word the first counts
        reach = _GAP.match(text, start).end()
        head = _FIRST.match(text, reach)
        for pattern, name in first_words.get(head[0].lower(), ()) if head else ():
            if m := pattern.match(text, reach):
                begin = reach - len(text[start:reach].lstrip())
                if found.get(begin, (0, ""))[0] < m.end():
                    found[begin] = (m.start() + len(m[0].rstrip()), name)
    out: list[tuple[int, int, str | None]] = []
    covered = 0
    for start, end, name in sorted([(s, e, n) for s, (e, n) in found.items()] + [(s, e, None) for s, e in plain], key=lambda x: (x[0], x[2] is None, -x[1])):
        if start >= covered:
            out.append((start, end, name))
            covered = end
        elif name is not None and (not out or out[-1][2] is None):
            out[-1] = (start, end, name)
            covered = max(covered, end)
    return out


@functools.lru_cache(8)
def _by_first_id(rules: tuple[tuple[str, tuple[str, ...]], ...]) -> dict[str, list[tuple[int, str, tuple[str, ...]]]]:
    """(number, licence, ids) of the rules that begin with an id."""
    out: dict[str, list[tuple[int, str, tuple[str, ...]]]] = {}
    for number, (licence, sequence) in enumerate(rules):
        out.setdefault(sequence[0], []).append((number, licence, sequence))
    return out


def matches(text: str | None, table: dict[str, str], rules: tuple[tuple[str, tuple[str, ...]], ...], gap: int) -> list[tuple[str, int, int, int, str]]:
    """(licence, rule number, start, end, sentence ids) in order; the longest rule from a sentence wins and its sentences are used up."""
    ids = sentence_ids(text or "", table)
    marks = [k for k, x in enumerate(ids) if x[2] is not None]
    out, after = [], -1
    for k in marks:
        if k <= after:
            continue
        best = None
        for number, licence, sequence in _by_first_id(rules).get(ids[k][2], ()):
            at, last = k, k
            for want, name in enumerate(sequence):
                at = next((j for j in range(last if want == 0 else last + 1, min(len(ids), last + (1 if want == 0 else gap + 2))) if ids[j][2] == name), None)
                if at is None:
                    break
                last = at
            if at is not None and (best is None or len(sequence) > len(best[2])):
                best = (number, licence, sequence, last)
        if best:
            out.append((best[1], best[0], ids[k][0], ids[best[3]][1], ",".join(best[2])))
            after = best[3]
    return out


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES, gap: int = GAP) -> DataFrame:
    """One row a rule match: doc_id, licence, rule, start_char, end_char, sentence_ids.

    Null, empty and unlicensed texts give no rows; repeated rows repeat theirs; other columns are ignored; an empty table gives no rows.
    """
    prepare(df.sparkSession)
    table = known(sentences)
    schema = pa.schema([("doc_id", pa.int64()), ("licence", pa.string()), ("rule", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("sentence_ids", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, *m) for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)) for m in matches(text, table, rules, gap)]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(task, "doc_id long, licence string, rule int, start_char int, end_char int, sentence_ids string")
