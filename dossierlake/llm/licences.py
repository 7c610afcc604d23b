"""Licence scans by sentence rules: a text's sentences are normalised and looked up among known licence sentences; the
resulting sequence of sentence identifiers is matched against ordered rules that name a licence.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dossierlake.llm import words as W

# Known licence sentences, one a line, as identifier and sentence. Several wordings may share an identifier.
SENTENCES = """
mit-ref|Released under the MIT License
mit-ref|Licensed under the MIT License
mit-ref|This project is licensed under the MIT License
mit-ref|This software is released under the MIT License
mit-ref|Distributed under the MIT License
mit-ref|SPDX-License-Identifier: MIT
mit-title|The MIT License
mit-title|The MIT License (MIT)
mit-title|MIT License
mit-grant|Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software
mit-grant-only|Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
mit-notice|The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software
as-is-mit|THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT
apache2-ref|Licensed under the Apache License, Version 2.0
apache2-ref|Released under the Apache License, Version 2.0
apache2-ref|Licensed under the Apache License, Version 2.0 (the "License")
apache2-ref|Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License
apache2-ref|SPDX-License-Identifier: Apache-2.0
apache2-copy|You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
apache2-as-is|Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied
apache2-limits|See the License for the specific language governing permissions and limitations under the License
gpl3-ref|This work is licensed under the GNU General Public License, version 3
gpl3-ref|Licensed under the GNU General Public License, version 3
gpl3-ref|Released under the GNU General Public License, version 3
gpl3-ref|Licensed under the GPL, version 3
gpl3-ref|SPDX-License-Identifier: GPL-3.0-only
gpl3-later-ref|SPDX-License-Identifier: GPL-3.0-or-later
gpl2-ref|Licensed under the GNU General Public License, version 2
gpl2-ref|This work is licensed under the GNU General Public License, version 2
gpl2-ref|SPDX-License-Identifier: GPL-2.0-only
gpl3-later|This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version
gpl2-later|This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version
gpl-hope|This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE
gpl-details|See the GNU General Public License for more details
lgpl3-ref|Licensed under the GNU Lesser General Public License, version 3
lgpl3-ref|SPDX-License-Identifier: LGPL-3.0-only
agpl3-ref|Licensed under the GNU Affero General Public License, version 3
agpl3-ref|SPDX-License-Identifier: AGPL-3.0-only
mpl2-ref|This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0
mpl2-ref|Licensed under the Mozilla Public License, version 2.0
mpl2-ref|SPDX-License-Identifier: MPL-2.0
mpl2-copy|If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/
ccby4-ref|Licensed under CC BY 4.0
ccby4-ref|This work is licensed under a Creative Commons Attribution 4.0 International License
ccby4-ref|SPDX-License-Identifier: CC-BY-4.0
ccbysa4-ref|Licensed under CC BY-SA 4.0
ccbysa4-ref|This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License
ccbysa4-ref|SPDX-License-Identifier: CC-BY-SA-4.0
ccbync4-ref|Licensed under CC BY-NC 4.0
ccbync4-ref|This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License
ccbync4-ref|SPDX-License-Identifier: CC-BY-NC-4.0
cc0-ref|Licensed under CC0 1.0
cc0-ref|SPDX-License-Identifier: CC0-1.0
bsd-grant|Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
bsd-source|Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
bsd-binary|Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution
bsd-names|Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd3-ref|Licensed under the BSD 3-Clause License
bsd3-ref|SPDX-License-Identifier: BSD-3-Clause
bsd2-ref|Licensed under the BSD 2-Clause License
bsd2-ref|SPDX-License-Identifier: BSD-2-Clause
isc-grant|Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies
isc-ref|SPDX-License-Identifier: ISC
unlicense-grant|This is free and unencumbered software released into the public domain
reserved|All rights reserved
"""

# Rules, one a line, as licence and the identifiers that must follow one another.
RULES = """
MIT|mit-ref
MIT|mit-title
MIT|mit-grant
MIT|mit-grant-only mit-notice
MIT|mit-title mit-grant
MIT|mit-title mit-grant as-is-mit
MIT|mit-grant as-is-mit
MIT|mit-title mit-grant-only mit-notice as-is-mit
MIT|mit-grant-only mit-notice as-is-mit
Apache-2.0|apache2-ref
Apache-2.0|apache2-ref apache2-copy
Apache-2.0|apache2-ref apache2-copy apache2-as-is
Apache-2.0|apache2-ref apache2-copy apache2-as-is apache2-limits
GPL-3.0-only|gpl3-ref
GPL-2.0-only|gpl2-ref
GPL-3.0-or-later|gpl3-later-ref
GPL-3.0-or-later|gpl3-later
GPL-3.0-or-later|gpl3-later gpl-hope
GPL-3.0-or-later|gpl3-later gpl-hope gpl-details
GPL-2.0-or-later|gpl2-later
GPL-2.0-or-later|gpl2-later gpl-hope
GPL-2.0-or-later|gpl2-later gpl-hope gpl-details
LGPL-3.0-only|lgpl3-ref
AGPL-3.0-only|agpl3-ref
MPL-2.0|mpl2-ref
MPL-2.0|mpl2-ref mpl2-copy
CC-BY-4.0|ccby4-ref
CC-BY-SA-4.0|ccbysa4-ref
CC-BY-NC-4.0|ccbync4-ref
CC0-1.0|cc0-ref
BSD-2-Clause|bsd2-ref
BSD-2-Clause|bsd-grant bsd-source bsd-binary
BSD-3-Clause|bsd3-ref
BSD-3-Clause|bsd-grant bsd-source bsd-binary bsd-names
ISC|isc-ref
ISC|isc-grant
Unlicense|unlicense-grant
Proprietary|reserved
"""

# Sentences end at line breaks and at . ! ? ; that white space follows; a sentence of a licence may also run over lines.
_END = re.compile(r"\n|(?<=[.!?;])[ \t]+")
_NOISE = re.compile(r"[^a-z0-9]+")
MATCH = "array<struct<licence:string, sentences:array<string>, first:int, last:int>>"
# Unknown sentences that may stand between two sentences of a rule.
MOST_GAP = 2
# The sentence that is no licence beside another.
RESERVED = "reserved"


def normal(sentence: str) -> str:
    """Lower-cased ASCII letters and digits, everything else as single spaces."""
    return _NOISE.sub(" ", sentence.lower()).strip()


KNOWN = {normal(text): name for name, text in (line.split("|", 1) for line in SENTENCES.strip().split("\n"))}
ORDERED = sorted(((licence, tuple(ids.split())) for licence, ids in (line.split("|") for line in RULES.strip().split("\n"))), key=lambda r: (-len(r[1]), r))
_STARTS = sorted(KNOWN)


def _open(part: str) -> bool:
    """Whether some known sentence begins with this part and goes on."""
    at = bisect_left(_STARTS, part + " ")
    return at < len(_STARTS) and _STARTS[at].startswith(part + " ")


def recognised(text: str | None) -> list[tuple[int, int, str]]:
    """(first part, last part, identifier) of the licence sentences of a text; parts are its sentences and lines, from 0."""
    parts = [normal(p) for p in _END.split(text or "")]
    out, at = [], 0
    while at < len(parts):
        joined, best = parts[at], None
        last = at
        while joined:
            if joined in KNOWN:
                best = (at, last, KNOWN[joined])
            if last + 1 >= len(parts) or not _open(joined):
                break
            last += 1
            if parts[last]:
                joined += " " + parts[last]
        if best:
            out.append(best)
            at = best[1]
        at += 1
    return out


def _followed(found: list[tuple[int, int, str]]) -> list[dict]:
    out, at = [], 0
    while at < len(found):
        for licence, ids in ORDERED:
            steps = found[at: at + len(ids)]
            if tuple(s[2] for s in steps) == ids and all(b[0] - a[1] - 1 <= MOST_GAP for a, b in zip(steps, steps[1:])):
                out.append({"licence": licence, "sentences": list(ids), "first": steps[0][0], "last": steps[-1][1]})
                at += len(ids) - 1
                break
        at += 1
    return out


def matches(text: str | None) -> list[dict]:
    """The rules that a text's sentences follow, from left to right, the longest rule first; each sentence counts once.

    Many licences open with a copyright line that reserves all rights. Such a sentence stands between the others like an
    unknown one, and counts as a licence of its own only in texts that follow no other rule.
    """
    found = recognised(text)
    return _followed([s for s in found if s[2] != RESERVED]) or _followed([s for s in found if s[2] == RESERVED])


def scan(docs: DataFrame) -> DataFrame:
    """(row, matches) for every row of docs(text, ...): `row` is the row as a struct; matches name the licence, the
    sentence identifiers and the first and last part of the text. Null, empty and unlicensed texts have no matches."""
    packed = docs.select(F.struct("*").alias("row"), "text")
    kind = packed.select(F.array().cast(MATCH).alias("m")).schema["m"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.list_(pa.struct([("licence", pa.string()), ("sentences", pa.list_(pa.string())), ("first", pa.int32()), ("last", pa.int32())]))
        for batch in W.pieces(batches):
            yield pa.record_batch([batch.column("row"), pa.array([matches(t) for t in batch.column("text").to_pylist()], arrow)], ["row", "matches"])

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, matches {kind.simpleString()}")
