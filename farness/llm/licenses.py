"""Licence scans (native): sentences become identifiers, identifier sequences are matched against ordered rules.

A text is cut twice, into lines and into paragraphs whose wrapped lines are joined (comment marks vanish, a line of nothing else
parts paragraphs); both are cut at sentence ends, lower-cased and reduced to a-z, 0-9 and single spaces. A colon or semicolon ends a sentence
too, so the licences' sentences are known by the parts that this leaves. Sentences of the fixed table become identifiers, so does each
name in the expression behind an SPDX tag; the others vanish, and the rules, in order, take the identifiers they match,
so that a later, more general rule can't use them again.

Only DataFrame functions, each document within its own row: no shuffle, nothing is collected. A text that holds none of the
cues, one of which every known sentence holds, has an empty sequence without being cut.

Defined results: null and empty texts have no identifiers and no licence ('' and 'none'); repeats of a sentence give
repeated identifiers; rows are judged alone; clashing columns stay untouched; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farness.llm.common import spare

#: Normalised licence sentences and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "A1",
    "you may not use this file except in compliance with the license": "A2",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "A3",
    "released under the mit license": "M1",
    "licensed under the mit license": "M1",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "M2",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "M3",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "B1",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation": "B2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "B0",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "B3",
    "this work is licensed under the gnu general public license version 3": "G1",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "G2",
    "all rights reserved": "R1",
    "the software is provided as is without warranty of any kind express or implied": "W1",
}
#: Sentences and parts of sentences as the licences' own texts have them.
SENTENCES |= {
    "licensed under the apache license version 2 0 the license": "A1",
    "http www apache org licenses license 2 0": "A3",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "A5",
    "see the license for the specific language governing permissions and limitations under the license": "A6",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "M2",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "B2",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "W1",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "I1",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "I1",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "I3",
    "this source code form is subject to the terms of the mozilla public license v": "P1",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "P2",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "P2",
    "this is free and unencumbered software released into the public domain": "U1",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "E1",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0": "E1",
    "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "E5",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "E5",
}
#: How the notices of the GNU licences begin and end, and the identifiers of what they name, alone and with a version.
GNU_TERMS, GNU_END = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation", "either version {} of the license or at your option any later version"
GNU = {
    "general public license": ("G7", {"2": "G4", "3": "G2"}),
    "lesser general public license": ("L5", {"2": "L6", "2 1": "L1", "3": "L2"}),
    "library general public license": ("L5", {"2": "L6"}),
    "affero general public license": ("N3", {"3": "N1"}),
}
for _kind, (_any, _versions) in GNU.items():
    SENTENCES[GNU_TERMS.format(_kind)] = _any
    for _v, _id in _versions.items():
        SENTENCES[f"{GNU_TERMS.format(_kind)} {GNU_END.format(_v)}"] = _id
        SENTENCES[GNU_END.format(_v)] = {"2": "V2", "2 1": "V1", "3": "V3"}[_v]
SENTENCES[GNU_TERMS.format("general public license version 2")] = "G8"
SENTENCES[GNU_TERMS.format("general public license").replace("the gnu", "version 2 of the gnu")] = "G8"
#: Names behind 'licensed under' and the like.
HEADS = ("licensed under", "released under", "distributed under", "this work is licensed under", "this project is licensed under", "this software is licensed under", "this program is licensed under")
NAMES = {
    "the mit license": "M1", "the apache license version 2 0": "A1", "the isc license": "I5", "the bsd 2 clause license": "B7", "the bsd 3 clause license": "B8",
    "the gnu general public license version 3": "G1", "the gnu general public license version 2": "G9", "the gnu lesser general public license version 2 1": "L7",
    "the gnu lesser general public license version 3": "L8", "the gnu affero general public license version 3": "N4", "the mozilla public license version 2 0": "P4",
    "the eclipse public license version 2 0": "E4", "the unlicense": "U3",
}
#: The parts of Creative Commons names, in words, and the identifiers of their combinations.
CC_WORDS = {"by": "attribution", "nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
CC = {"by nc": "C1", "by": "C2", "by sa": "C3", "by nd": "C4", "by nc sa": "C5", "by nc nd": "C6"}
for _parts, _id in CC.items():
    _words = " ".join(CC_WORDS[x] for x in _parts.split())
    NAMES |= {f"cc {_parts} 4 0": _id, f"a creative commons {_words} 4 0 international license": _id, f"the creative commons {_words} 4 0 international license": _id}
for _head in HEADS:
    for _name, _id in NAMES.items():
        if "licen" in f"{_head} {_name}":
            SENTENCES.setdefault(f"{_head} {_name}", _id)
#: Names in SPDX expressions, 'plus' for 'or later', and their identifiers.
SPDX_TAG = "spdx license identifier"
SPDX = {
    "mit": "M4", "apache 2 0": "A4", "bsd 2 clause": "B4", "bsd 3 clause": "B5", "isc": "I2", "0bsd": "I4", "mpl 2 0": "P3", "epl 2 0": "E2", "epl 1 0": "E3", "unlicense": "U2",
    "cc0 1 0": "C0", "zlib": "Z1", "bsl 1 0": "Z2", "wtfpl": "Z3", "artistic 2 0": "Z4", "postgresql": "Z5",
}
for _name, _id in {"gpl 2 0": "G5", "gpl 3 0": "G3", "lgpl 2 0": "L9", "lgpl 2 1": "L3", "lgpl 3 0": "L4", "agpl 3 0": "N2"}.items():
    SPDX |= dict.fromkeys((_name, f"{_name} only", f"{_name} plus"), _id)
SPDX |= {f"cc {_parts} 4 0": _id for _parts, _id in CC.items()}
#: What stands for the names that a sentence of the BSD licences leaves open.
OPEN_NAME, HOLDER = "^neither the name of .{1,80} nor the names of its contributors ", "neither the name of the copyright holder nor the names of its contributors "
#: Every sentence above holds at least one of these, within a word, so that no normalising changes it.
CUES = ("licen", "permission", "redistribut", "copyright", "reserved", "warranty", "mozilla", "unencumbered")
#: Ordered rules (licence, category, pattern over a sequence such as ' B0  B1  B2 ').
RULES = (
    ("Apache-2.0", "permissive", " A[1-4] ( A[1-6] )*"),
    ("MIT", "permissive", " M2  M3 ( W1 )?"),
    ("MIT", "permissive", " M[14] ( W1 )?"),
    ("BSD-3-Clause", "permissive", " B0  B1  B2  B3 ( W1 )?"),
    ("BSD-2-Clause", "permissive", " B0  B1  B2 ( W1 )?"),
    ("BSD-3-Clause", "permissive", " B[58] "),
    ("BSD-2-Clause", "permissive", " B[47] "),
    ("ISC", "permissive", " I[125] ( W1 )?"),
    ("0BSD", "permissive", " I[34] ( W1 )?"),
    ("GPL-3.0", "copyleft", " G[1-3] ( G[1-3] )*"),
    ("GPL-3.0", "copyleft", " G7  V3 "),
    ("GPL-2.0", "copyleft", " G7  V2 "),
    ("GPL-2.0", "copyleft", " G[4589] ( G[4589] )*"),
    ("LGPL-2.1", "copyleft", " (L5  V1|L[137]) "),
    ("LGPL-3.0", "copyleft", " (L5  V3|L[248]) "),
    ("LGPL-2.0", "copyleft", " (L5  V2|L[69]) "),
    ("AGPL-3.0", "copyleft", " (N3  V3|N[124]) "),
    ("MPL-2.0", "copyleft", " P[134] ( P2 )?"),
    ("EPL-2.0", "copyleft", " E[124] "),
    ("EPL-1.0", "copyleft", " E[35] "),
    ("Unlicense", "permissive", " U[123] "),
    ("CC0-1.0", "permissive", " C0 "),
    ("Zlib", "permissive", " Z1 "),
    ("BSL-1.0", "permissive", " Z2 "),
    ("WTFPL", "permissive", " Z3 "),
    ("Artistic-2.0", "permissive", " Z4 "),
    ("PostgreSQL", "permissive", " Z5 "),
    ("CC-BY-NC-4.0", "noncommercial", " C1 "),
    ("CC-BY-NC-SA-4.0", "noncommercial", " C5 "),
    ("CC-BY-NC-ND-4.0", "noncommercial", " C6 "),
    ("CC-BY-SA-4.0", "copyleft", " C3 "),
    ("CC-BY-ND-4.0", "other", " C4 "),
    ("CC-BY-4.0", "permissive", " C2 "),
    ("proprietary", "reserved", " R1 "),
    ("unnamed", "other", " [A-Z][0-9] "),
)
#: Of several categories the first here names the document.
CATEGORIES = ("reserved", "noncommercial", "copyleft", "permissive", "other")
SENTENCE_END = r"\n|[.;:!?]+([ \t\r]+|\n|\z)"
#: Between paragraphs: line ends with nothing but blanks and comment marks between them.
PARAGRAPH = r"\n[ \t\r*#/;%-]*\n"
#: Between the lines of a paragraph.
LINE_END = r"\n[ \t*#/;%-]*"


def sentences_of(text: Column) -> Column:
    """The normalised sentences of a lower-case text, without empty ones."""
    plain = F.transform(F.split(text, SENTENCE_END), lambda x: F.btrim(F.regexp_replace(x, "[^a-z0-9]+", " ")))
    return F.transform(F.filter(plain, lambda x: x != ""), lambda x: F.when(F.startswith(x, F.lit("neither the name")), F.regexp_replace(x, OPEN_NAME, HOLDER)).otherwise(x))


def _name_in(x: Column, table: dict[str, str]) -> Column:
    """' A1 ' for a text of the table; '' for others."""
    by_id: dict[str, list[str]] = {}
    for text, name in table.items():
        by_id.setdefault(name, []).append(text)
    out = F.lit("")
    for name, of in by_id.items():
        out = F.when(x.isin(*of), F.lit(f" {name} ")).otherwise(out)
    return F.when(x.isin(*table), out).otherwise(F.lit(""))


def sequence(sentences: Column) -> Column:
    """' A1  W1 ' of a plain column of normalised sentences; '' if none is known."""

    def name_of(x: Column, i: Column) -> Column:
        behind = F.coalesce(F.get(sentences, i - 1) == SPDX_TAG, F.lit(False))
        tagged = F.startswith(x, F.lit(f"{SPDX_TAG} "))
        expression = F.replace(F.when(tagged, F.substr(x, F.lit(len(SPDX_TAG) + 2))).otherwise(x), F.lit(" or later"), F.lit(" plus"))
        names = F.concat_ws("", F.transform(F.split(expression, " (?:or|and|with) "), lambda p: _name_in(p, SPDX)))
        own = _name_in(x, SENTENCES)
        return F.when(own != "", own).when(behind | tagged, names).otherwise(F.lit(""))

    return F.concat_ws("", F.transform(sentences, name_of))


def scan_licences(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus line_ids and paragraph_ids (identifier sequences), licences (comma-joined, in the rules' order) and category.

    category is the strictest found, 'none' without any. New columns take spare names on a clash and come last.
    """
    names = ("line_ids", "paragraph_ids", "licences", "category")
    out = dict(zip(names, spare(docs, *names), strict=True))
    low, lines, wrapped, found, cut, joined = spare(docs, "_low", "_lines", "_wrapped", "_found", "_cut", "_joined")
    df = docs.select("*", F.lower(F.coalesce(F.col(text), F.lit(""))).alias(low))
    cued = F.lit(False)
    for cue in CUES:
        cued = cued | F.contains(F.col(low), F.lit(cue))
    df = df.select(
        "*",
        F.when(cued, sentences_of(F.col(low))).alias(cut),
        F.when(cued, sentences_of(F.regexp_replace(F.regexp_replace(low, PARAGRAPH, ". "), LINE_END, " "))).alias(joined),
    )
    df = df.select("*", *[F.when(F.col(x).isNotNull(), sequence(F.col(x))).otherwise(F.lit("")).alias(name) for x, name in ((cut, lines), (joined, wrapped))])
    left = {lines: F.col(lines), wrapped: F.col(wrapped)}
    marks = []
    for licence, category, pattern in RULES:
        hit = F.lit(False)
        for k in left:
            hit = hit | F.rlike(left[k], F.lit(pattern))
            left[k] = F.regexp_replace(left[k], pattern, "")
        marks.append(F.when(hit, F.lit(f"{licence}:{category}")))
    some = (F.col(lines) != "") | (F.col(wrapped) != "")
    df = df.select("*", F.when(some, F.array_distinct(F.array_compact(F.array(*marks)))).otherwise(F.array().cast("array<string>")).alias(found))
    # sentences of no named licence count only where there is no other
    df = df.withColumn(found, F.when(F.size(found) > 1, F.array_remove(found, "unnamed:other")).otherwise(F.col(found)))
    category = F.lit("none")
    ends = lambda c: lambda x: F.endswith(x, F.lit(f":{c}"))
    for c in reversed(CATEGORIES):
        category = F.when(F.exists(found, ends(c)), F.lit(c)).otherwise(category)
    return df.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.btrim(F.regexp_replace(lines, "  ", ",")).alias(out["line_ids"]),
        F.btrim(F.regexp_replace(wrapped, "  ", ",")).alias(out["paragraph_ids"]),
        F.concat_ws(",", F.transform(found, lambda x: F.substring_index(x, ":", 1))).alias(out["licences"]),
        category.alias(out["category"]),
    )
