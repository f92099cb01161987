"""Licence notices as they are published, plain, wrapped anew and behind comment marks; SPDX tags; and the same by SQL."""

from __future__ import annotations

import textwrap

import duckdb
import pandas as pd
import pytest

from farness.llm.licenses import CC, CUES, SPDX, scan_licences
from farness.llm.op8 import OP8_SQL

DOCS = "doc_id long, text string"
GNU = """This {what} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by
the Free Software Foundation{b} either version {version} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details."""
NOTICES = {
    "GPL-2.0": GNU.format(what="program", a=";", kind="General", b=";", version="2"),
    "GPL-3.0": GNU.format(what="program", a=":", kind="General", b=",", version="3"),
    "LGPL-2.1": GNU.format(what="library", a=";", kind="Lesser General", b=";", version="2.1"),
    "LGPL-3.0": GNU.format(what="library", a=":", kind="Lesser General", b=",", version="3"),
    "AGPL-3.0": GNU.format(what="program", a=":", kind="Affero General", b=",", version="3"),
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Apache-2.0": """Copyright 2020 Somebody

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License.""",
    "ISC": """Copyright (c) 2020, Somebody

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.""",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy it.",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met:

    * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
    * Neither the name of Somebody and Sons nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
}


def wrapped(text, mark, width):
    parts = [textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n")]
    return "\n".join(f"{mark}{x}".rstrip() for x in "\n\n".join(parts).split("\n"))


def texts_and_names():
    for name, text in NOTICES.items():
        yield text, name
        for mark, width in (("# ", 60), (" * ", 72), ("// ", 50), (";; ", 80)):
            yield f"/* head */\nint x;\n\n{wrapped(text, mark, width)}\n\nint y;", name


def scanned(spark, texts):
    rows = scan_licences(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    return [(r.line_ids, r.paragraph_ids, r.licences, r.category) for r in sorted(rows, key=lambda r: r.doc_id)]


TAGS = {
    "MIT": "MIT", "Apache-2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "ISC": "ISC", "0BSD": "0BSD", "MPL-2.0": "MPL-2.0", "EPL-2.0": "EPL-2.0",
    "EPL-1.0": "EPL-1.0", "Unlicense": "Unlicense", "CC0-1.0": "CC0-1.0", "Zlib": "Zlib", "BSL-1.0": "BSL-1.0", "WTFPL": "WTFPL", "Artistic-2.0": "Artistic-2.0", "PostgreSQL": "PostgreSQL",
    "GPL-2.0": "GPL-2.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-2.0+": "GPL-2.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0", "LGPL-2.1-only": "LGPL-2.1",
    "LGPL-2.0-or-later": "LGPL-2.0", "LGPL-3.0-or-later": "LGPL-3.0", "AGPL-3.0-only": "AGPL-3.0", "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0",
    "CC-BY-ND-4.0": "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0": "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0": "CC-BY-NC-ND-4.0", "(MIT OR Apache-2.0)": "Apache-2.0,MIT",
    "GPL-2.0-or-later WITH Classpath-exception-2.0": "GPL-2.0", "MIT AND (BSD-3-Clause OR ISC)": "MIT,BSD-3-Clause,ISC", "LicenseRef-own": "",
}


@pytest.fixture(scope="module")
def cases():
    out = list(texts_and_names())
    for tag, name in TAGS.items():
        out += [(f"{mark}SPDX-License-Identifier: {tag}{end}\nint x;", name) for mark, end in (("// ", ""), ("/* ", " */"), ("# ", "\r"))]
    return out + [("SPDX-License-Identifier MIT", "MIT"), ("SPDX-License-Identifier: x\n\nMIT", ""), ("MIT. GPL-3.0-only. SPDX.", ""), (None, ""), ("", "")]


def test_published_notices_and_tags(spark, cases):
    assert [(t, x[2]) for (t, _), x in zip(cases, scanned(spark, [t for t, _ in cases]), strict=True)] == cases


def test_sql_gives_the_same(spark, cases):
    con = duckdb.connect()
    con.register("frame", pd.DataFrame({"doc_id": range(len(cases)), "text": [t for t, _ in cases]}))
    con.sql("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) doc_id, CAST(text AS VARCHAR) text FROM frame")
    want = con.sql(OP8_SQL).df().sort_values("doc_id")
    assert [tuple(r) for r in want[["line_ids", "paragraph_ids", "licences", "category"]].itertuples(index=False)] == scanned(spark, [t for t, _ in cases])


def test_tags_hold_a_cue_and_cover_creative_commons():
    assert any(c in "spdx-license-identifier" for c in CUES) and {f"cc {x} 4 0" for x in CC} <= set(SPDX)
