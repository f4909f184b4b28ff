"""License scans by conditional compression.

1. Candidate blocks: runs of words around three-word phrases of any template (at most GAP words between phrases,
   CLUSTER words in all). A notice that differs from a template of n words in at most e = min(n // 5, (n - 3) // 3)
   words keeps at least one of the template's n - 2 phrases, so no true match is missed, and nothing here depends
   on which template a phrase came from.
2. Every block is compressed by zstandard plainly and with each template as raw dictionary; templates are ranked
   by the bytes that they save.
3. Winners are confirmed in that order by the exact wording difference: the least number of words inserted,
   deleted or replaced between the template and any stretch of the text around the block. The first template with
   at most e differences is the block's; of equal savings the one that differs less, then the first of the list.
   What lies before and after the match is a block again. A template that saves nothing is no winner.

Words are runs of a-z, 0-9 and non-ASCII bytes after lower-casing A-Z; all else divides them.

Null and empty texts have no block. Repeated rows are scanned again. Other columns are not read. An empty
table gives an empty result. Texts are scanned whole, however long: work is in proportion to the words, and the
words of one text are held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices of public licenses (fixed values): identifier, wording.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under the CC0 1.0 Universal dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
)
SCHEMA = "n_blocks long, n_matches long, license_ids string, best_reduction double, least_difference long"
#: Words between phrases of one block, and words of a block, at most.
GAP, CLUSTER = 8, 256
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))
_open: list[Scanner] = []


def words(text: str) -> list[str]:
    """The words, as strings of one character a byte."""
    return text.encode().translate(_BYTES).decode("latin-1").split()


def _edits(a: np.ndarray, b: np.ndarray, anywhere: bool) -> np.ndarray:
    """Least edits between a and b[:j] for each j, or, with anywhere, between a and any stretch that ends at j."""
    at = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64) if anywhere else at.copy()
    for x in a:
        new = row + 1
        np.minimum(new[1:], row[:-1] + (b != x), out=new[1:])
        row = np.minimum.accumulate(new - at) + at
    return row


def difference(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Least edits between a and any stretch of b, and that stretch: the first to end, then of the length nearest to a's."""
    ends = _edits(a, b, True)
    stop = int(ends.argmin())
    back = _edits(a[::-1], b[:stop][::-1], False)
    length = min(np.flatnonzero(back == ends[stop]).tolist(), key=lambda j: (abs(j - len(a)), j))
    return int(ends[stop]), stop - length, stop


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.names = [n for n, _ in templates]
        self.words = [words(t) for _, t in templates]
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for t in self.words for w in t))}
        self.coded = [np.array([self.number[w] for w in t]) for t in self.words]
        self.allowed = [max(0, min(len(w) // 5, (len(w) - 3) // 3)) for w in self.words]
        self.plain = zstandard.ZstdCompressor(level=3)
        self.given = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict((" ".join(w) + " ").encode("latin-1"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for w in self.words]
        self.machine = ahocorasick.Automaton()
        for w in self.words:
            for i in range(len(w) - 2):
                phrase = " ".join(w[i : i + 3]) + " "
                self.machine.add_word(phrase, len(phrase))
        self.machine.make_automaton()

    def phrases(self, every: list[str]) -> list[int]:
        """Places of the words at which a phrase of any template begins."""
        joined = " ".join(every) + " "
        found, at, count = [], 0, 0
        for begin in sorted({end + 1 - n for end, n in self.machine.iter(joined)}):
            if begin and joined[begin - 1] != " ":
                continue  # it begins inside a word
            count += joined.count(" ", at, begin)
            at = begin
            found.append(count)
        return found

    def rank(self, block: list[str]) -> list[tuple[int, int, float]]:
        """Bytes saved, template and share saved of those that save any, by savings."""
        raw = " ".join(block).encode("latin-1")
        plain = len(self.plain.compress(raw))
        saved = [plain - len(c.compress(raw)) for c in self.given]
        return sorted(((s, k, s / plain) for k, s in enumerate(saved) if s > 0), key=lambda x: -x[0])

    def winner(self, every: list[str], block: list[int], low: int, high: int):
        """The block's match: start, stop, differences, share saved, template; looked for between the words low and high."""
        ranked = self.rank(every[block[0] : block[-1] + 3])
        best = None
        for saved, k, share in ranked:
            if best and saved < best[0]:
                break
            reach = len(self.words[k]) + self.allowed[k]
            a = max(low, block[0] - reach)
            edits, start, stop = difference(self.coded[k], np.array([self.number.get(w, -1) for w in every[a : min(high, block[-1] + 3 + reach)]]))
            if edits <= self.allowed[k] and any(a + start <= p < a + stop for p in block) and (best is None or edits < best[1][2]):
                best = saved, (a + start, a + stop, edits, share, k)
        return best and best[1]

    def scan(self, text: str) -> tuple[int, list[tuple[str, float, int]]]:
        """Candidate blocks, and (license, size reduction, word differences) of each confirmed one."""
        every = words(text)
        blocks: list[list[int]] = []
        for p in self.phrases(every) if len(every) > 2 else ():
            if not blocks or p - blocks[-1][-1] > GAP + 3 or p - blocks[-1][0] > CLUSTER:
                blocks.append([])
            blocks[-1].append(p)
        found, low = [], 0
        for block in blocks:
            ps = [p for p in block if p >= low]  # a match may reach into the next block
            left = [(ps, low, len(every))] if ps else []
            while left:
                ps, a, z = left.pop()
                if not (hit := self.winner(every, ps, a, z)):
                    continue
                found.append(hit)
                low = max(low, hit[1])
                # of what it doesn't cover, phrases on either side are blocks of their own
                left += [(rest, *ends) for rest, ends in (([p for p in ps if p < hit[0]], (a, hit[0])), ([p for p in ps if p >= hit[1]], (hit[1], z))) if rest]
        return len(blocks), [(self.names[k], share, edits) for _, _, edits, share, k in sorted(found)]


def scanner() -> Scanner:
    if not _open:
        _open.append(Scanner())
    return _open[0]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_blocks, n_matches, license_ids (distinct, by comma), best_reduction, least_difference."""
    kind = docs.schema[id_col].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                blocks, found = s.scan(t or "")
                rows.append((blocks, len(found), ",".join(sorted({f[0] for f in found})), max((f[1] for f in found), default=None), min((f[2] for f in found), default=None)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], [id_col, "n_blocks", "n_matches", "license_ids", "best_reduction", "least_difference"])

    return docs.select(F.col(id_col), text_col).mapInArrow(apply, f"`{id_col}` {kind}, {SCHEMA}")
