"""Licence recognition: known licence sentences, then ordered rules over their identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_batches

# Sentences of public licences and notices, as their texts have them, by identifier.
SENTENCES = {
    "mit-released": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "This software is released under the MIT License.", "License: MIT.", "SPDX-License-Identifier: MIT"],
    "mit-grant": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
    ],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "as-is": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "apache-2-under": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License");', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "SPDX-License-Identifier: Apache-2.0"],
    "apache-comply": ["you may not use this file except in compliance with the License."],
    "license-copy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "gpl-3-under": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Licensed under the GPLv3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl-2-under": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "Licensed under the GPLv2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "lgpl-3-under": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "agpl-3-under": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "mpl-2-under": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "cc-by-4": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd-4": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
# Identifier sequences and the licence they stand for; the longest rule that fits at a place is taken.
RULES = [
    (("mit-grant", "mit-notice", "as-is"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("mit-released",), "MIT"),
    (("apache-2-under", "apache-comply", "license-copy"), "Apache-2.0"),
    (("apache-2-under", "license-copy"), "Apache-2.0"),
    (("apache-2-under", "apache-comply"), "Apache-2.0"),
    (("apache-2-under",), "Apache-2.0"),
    (("gpl-free", "gpl-hope"), "GPL-3.0-or-later"),
    (("gpl-free",), "GPL-3.0-or-later"),
    (("gpl-2-free", "gpl-hope"), "GPL-2.0-or-later"),
    (("gpl-2-free",), "GPL-2.0-or-later"),
    (("gpl-3-under",), "GPL-3.0-only"),
    (("gpl-2-under",), "GPL-2.0-only"),
    (("lgpl-3-under",), "LGPL-3.0-only"),
    (("agpl-3-under",), "AGPL-3.0-only"),
    (("mpl-2-under",), "MPL-2.0"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("isc-grant",), "ISC"),
    (("cc-by-4",), "CC-BY-4.0"),
    (("cc-by-sa-4",), "CC-BY-SA-4.0"),
    (("cc-by-nc-4",), "CC-BY-NC-4.0"),
    (("cc-by-nd-4",), "CC-BY-ND-4.0"),
    (("cc0",), "CC0-1.0"),
    (("unlicense",), "Unlicense"),
]

#: Every known sentence holds one of these.
_HINTS = ("licen", "permi", "redistribut", "warrant", "copyright", "unencumbered")
_PART = re.compile(r"(?:[^\n.:;!?]|[.:;!?](?!\s|\Z))*[.:;!?]*")
_OTHER = re.compile(r"[^a-z0-9]+")


def normalised(sentence: str) -> str:
    """Lower-case letters and digits, everything between them one space."""
    return _OTHER.sub(" ", sentence.lower()).strip()


_KNOWN = {normalised(s): key for key, sentences in SENTENCES.items() for s in sentences}
_BEGIN = {" ".join(words[:n]) for words in map(str.split, _KNOWN) for n in range(1, len(words))}
_BY_FIRST: dict[str, list] = {}
for _rule in sorted(RULES, key=lambda r: -len(r[0])):
    _BY_FIRST.setdefault(_rule[0][0], []).append(_rule)


def sentences_of(text: str) -> list[tuple[str, int, int]]:
    """(identifier, start, end) of the known sentences, in order; a sentence may run over lines and clauses."""
    parts = [(normalised(m[0]), *m.span()) for m in _PART.finditer(text) if m[0].strip()]
    parts = [p for p in parts if p[0]]
    found, i = [], 0
    while i < len(parts):
        joined, best = parts[i][0], None
        for j in range(i, len(parts)):
            if j > i:
                joined += " " + parts[j][0]
            if joined in _KNOWN:
                best = (_KNOWN[joined], parts[i][1], parts[j][2], j)
            if joined not in _BEGIN:
                break
        if best:
            found.append(best[:3])
        i = best[3] + 1 if best else i + 1
    return found


def licenses_of(text: str | None) -> list[tuple[str, int, int, str]]:
    """(licence, start, end, sentence identifiers) of each rule that fits, the longest first at any place."""
    plain = (text or "").lower()
    if not any(hint in plain for hint in _HINTS):
        return []
    found, out, i = sentences_of(text), [], 0
    while i < len(found):
        for sequence, name in _BY_FIRST.get(found[i][0], ()):
            if tuple(f[0] for f in found[i : i + len(sequence)]) == sequence:
                out.append((name, found[i][1], found[i + len(sequence) - 1][2], ",".join(sequence)))
                i += len(sequence) - 1
                break
        i += 1
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each licence found: ``doc_id, license_id, start, end`` (code points) and the ``sentences`` of its rule.

    Sentences are normalised to lower-case letters and digits and looked up among known
    licence sentences; the sequence of their identifiers is matched against ordered rules.
    Null, empty and licence-free texts give no rows. Repeated rows give theirs each; null ids
    stay null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *found) for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for found in licenses_of(text.as_py())]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "license_id", "start", "end", "sentences"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, license_id string, start long, end long, sentences string")
