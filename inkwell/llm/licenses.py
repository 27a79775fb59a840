"""Licence scans by sentence rules.

A text is cut into segments at line ends and sentence ends. Normalised (lower case, runs of other than letters
and digits to one space), a segment, or several in a row for a wrapped sentence, is looked up among the known
licence sentences. The identifiers found, in order, are matched against ordered rules, longest first: a rule
fires where its identifiers stand next to each other among the text's identifiers. One pass, no shuffle.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import map_rows

# Sentences of well-known licences and notices.
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "apache-the-license": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-unless": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-short": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-name": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-see": "See the GNU General Public License for more details",
    "lgpl-work": "This work is licensed under the GNU Lesser General Public License, version 3",
    "agpl-work": "This work is licensed under the GNU Affero General Public License, version 3",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-bsd3": "SPDX-License-Identifier: BSD-3-Clause",
}
RULES = [
    ("Apache-2.0", ("apache-the-license", "apache-comply", "apache-copy", "apache-url", "apache-unless", "apache-see")),
    ("Apache-2.0", ("apache-the-license", "apache-comply")),
    ("Apache-2.0", ("apache-the-license",)),
    ("Apache-2.0", ("apache-short",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("MIT", ("mit-name", "mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("spdx-mit",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-3.0-only", ("spdx-gpl3",)),
    ("LGPL-3.0-only", ("lgpl-work",)),
    ("AGPL-3.0-only", ("agpl-work",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-subject",)),
    ("Unlicense", ("unlicense",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC0-1.0", ("cc0",)),
]

_SEGMENT = re.compile(r"[^\n]+?(?:[.;:!?](?=\s)|(?=\n)|\Z)")
_OTHER = re.compile(r"[^0-9a-z]+")


def normalise(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


class Scanner:
    """Sentences and rules, ready to match."""

    def __init__(self, sentences: dict[str, str] | None = None, rules: list[tuple[str, tuple[str, ...]]] | None = None) -> None:
        known = SENTENCES if sentences is None else sentences
        self.ids = {normalise(s): k for k, s in known.items()}
        self.begins = {" ".join(s.split()[:i]) for s in self.ids for i in range(1, len(s.split()))}
        self.rules = sorted(RULES if rules is None else rules, key=lambda r: -len(r[1]))
        heads = sorted({s.split()[0] for s in self.ids})
        # only texts with a sentence's first word are cut up
        self.head = re.compile(r"(?i)(?<![0-9a-z])(?:" + "|".join(heads) + r")(?![0-9a-z])").search
        self.starts = {s.split()[0] for s in self.ids}

    def sentences(self, text: str) -> list[tuple[str, int, int]]:
        """(identifier, start, end) of the known sentences, in order; of sentences that begin at one segment the longest."""
        if not self.head(text):
            return []
        parts = [(m.start(), m.end(), normalise(m.group())) for m in _SEGMENT.finditer(text)]
        found, i = [], 0
        while i < len(parts):
            start, end, s = parts[i]
            best, k = None, i
            if s and s.split(" ", 1)[0] in self.starts:
                while True:
                    if s in self.ids and (best is None or best[0] != self.ids[s]):
                        best = (self.ids[s], start, parts[k][1], k)
                    if s not in self.begins or k + 1 >= len(parts):
                        break
                    k += 1
                    s = (s + " " + parts[k][2]).strip()
            if best:
                found.append(best[:3])
                i = best[3]
            i += 1
        return found

    def licences(self, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """(licence, start, end) of the rules that fire; a sentence serves one rule."""
        names = [f[0] for f in found]
        out, i = [], 0
        while i < len(names):
            for licence, ids in self.rules:
                if tuple(names[i : i + len(ids)]) == ids:
                    out.append((licence, found[i][1], found[i + len(ids) - 1][2]))
                    i += len(ids) - 1
                    break
            i += 1
        return out


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """doc_id, n_sentences, licenses (distinct, sorted, comma-joined), spans (licence:start:end in code points, comma-joined) for each row.

    A null or empty text has none; a null id stays null; repeated rows are scanned each; an empty table gives an
    empty one; other columns are ignored.
    """
    scanner = scanner or Scanner()
    schema = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("licenses", pa.string()), ("spans", pa.string())])

    def run(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": b["id"], "n_sentences": [], "licenses": [], "spans": []}
        for t in b["text"]:
            found = scanner.sentences(t or "")
            hits = scanner.licences(found)
            out["n_sentences"].append(len(found))
            out["licenses"].append(",".join(sorted({h[0] for h in hits})))
            out["spans"].append(",".join(f"{a}:{s}:{e}" for a, s, e in hits))
        return out

    return map_rows(docs, {"id": F.col(f"`{id_column}`").cast("long"), "text": F.col(f"`{text_column}`").cast("string")}, run, schema)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document names."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
