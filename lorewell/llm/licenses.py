r"""Operator 4, licence scans by the Dice coefficient over word bigrams.

Text is normalised to lower-case words without punctuation.  Templates are licence notices (built
from phrases x names), whole short licences, and the standard notices and opening parts of long ones,
as bags of word bigrams.  A passage is any run of words of a text; its Dice coefficient with a
template is 2 x (bigrams in common, with repeats) / (bigrams of the passage + of the template).

Dice >= t bounds a passage's size to [t / (2 - t), (2 - t) / t] x the template's, and its common
bigrams to at least t / 2 x (least size + template's).  Both prune: per block of texts the bigrams are looked up
in the templates' bigrams; a template is a candidate for a text only if the text has that many of its
bigrams; a passage may start only at a bigram of the template that has that many more within the
largest size.  For the starts that are left the Dice values of all passages that end at a bigram of the template come from
one cumulative sum, so work is linear in the text.  Whole texts are scanned in place, without a shuffle.

Results: license and dice of the best passage and n_matches, the number of passages of `threshold` or more that do not
overlap (taken best first; ties: the longer passage, template name, template, then start); null and empty texts and texts without a match
give null, 0 and 0.  Repeated rows get equal results; very long texts are scanned whole; an empty
table gives no rows; columns named like a result are replaced.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.llm.base import PUNCT, add_columns, buffers, grams, row_blocks, words

# Names of licences as notices write them, and the phrases before the name.
NAMES = {
    "Apache-2.0": "the Apache License, Version 2.0",
    "BSD-2-Clause": "the BSD 2-Clause License",
    "BSD-3-Clause": "the BSD 3-Clause License",
    "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-NC-ND-4.0": "CC BY-NC-ND 4.0",
    "CC-BY-NC-SA-4.0": "CC BY-NC-SA 4.0",
    "CC-BY-ND-4.0": "CC BY-ND 4.0",
    "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "AGPL-3.0": "the GNU Affero General Public License, version 3",
    "GPL-2.0": "the GNU General Public License, version 2",
    "GPL-3.0": "the GNU General Public License, version 3",
    "LGPL-2.1": "the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "the GNU Lesser General Public License, version 3",
    "ISC": "the ISC License",
    "MIT": "the MIT License",
    "MPL-2.0": "the Mozilla Public License, version 2.0",
    "Unlicense": "the Unlicense",
    "Zlib": "the zlib License",
}
PHRASES = ["Licensed under", "Released under", "Distributed under", "This work is licensed under", "This software is licensed under", "This project is licensed under"]
# Whole short licences, standard notices and opening parts of long ones.
BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
FREE_SOFTWARE = """{what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}
General Public License as published by the Free Software Foundation; either version {version} of the License, or (at
your option) any later version. {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} General
Public License for more details."""
CREATIVE = """This work is licensed under the Creative Commons {kind} 4.0 International License. To view a copy of this
license, visit http://creativecommons.org/licenses/{code}/4.0/ or send a letter to Creative Commons, PO Box 1866,
Mountain View, CA 94042, USA."""
CREATIVE_CODE = """By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and
conditions of this Creative Commons {kind} 4.0 International Public License ("Public License"). To the extent this
Public License may be interpreted as a contract, You are granted the Licensed Rights in consideration of Your acceptance
of these terms and conditions, and the Licensor grants You such rights in consideration of benefits the Licensor receives
from making the Licensed Material available under these terms and conditions."""
CREATIVE_KINDS = {
    "CC-BY-4.0": ("Attribution", "by"),
    "CC-BY-NC-4.0": ("Attribution-NonCommercial", "by-nc"),
    "CC-BY-NC-ND-4.0": ("Attribution-NonCommercial-NoDerivatives", "by-nc-nd"),
    "CC-BY-NC-SA-4.0": ("Attribution-NonCommercial-ShareAlike", "by-nc-sa"),
    "CC-BY-ND-4.0": ("Attribution-NoDerivatives", "by-nd"),
    "CC-BY-SA-4.0": ("Attribution-ShareAlike", "by-sa"),
}
GNU_KINDS = {"AGPL-3.0": ("Affero", "3"), "GPL-2.0": ("", "2"), "GPL-3.0": ("", "3"), "LGPL-2.1": ("Lesser", "2.1"), "LGPL-3.0": ("Lesser", "3")}
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details.""",
    "BSD-2-Clause": f"{BSD_GRANT} {BSD_WARRANTY}",
    "BSD-3-Clause": f"{BSD_GRANT} {BSD_NAMES} {BSD_WARRANTY}",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire
statement, including the above license grant, this restriction and the following disclaimer, must be included in all
copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS
PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR
ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the
author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make
this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution.""",
}
OPENINGS = {
    "Apache-2.0": """"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by
Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright
owner that is granting the License. "Legal Entity" shall mean the union of the acting entity and all other entities that
control, are controlled by, or are under common control with that entity.""",
    "GPL-2.0": """The licenses for most software are designed to take away your freedom to share and change it. By contrast,
the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the
software is free for all its users. This General Public License applies to most of the Free Software Foundation's
software and to any other program whose authors commit to using it.""",
    "GPL-3.0": """The GNU General Public License is a free, copyleft license for software and other kinds of works. The
licenses for most software and other practical works are designed to take away your freedom to share and change the
works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions
of a program--to make sure it remains free software for all its users.""",
    "AGPL-3.0": """The GNU Affero General Public License is a free, copyleft license for software and other kinds of works,
specifically designed to ensure cooperation with the community in the case of network server software. The licenses for
most software and other practical works are designed to take away your freedom to share and change the works. By
contrast, our General Public Licenses are intended to guarantee your freedom to share and change all versions of a
program--to make sure it remains free software for all its users.""",
    "LGPL-2.1": """The licenses for most software are designed to take away your freedom to share and change it. By
contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to
make sure the software is free for all its users. This license, the Lesser General Public License, applies to some
specially designated software packages--typically libraries--of the Free Software Foundation and other authors who
decide to use it.""",
    "LGPL-3.0": """This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3
of the GNU General Public License, supplemented by the additional permissions listed below.""",
    "MPL-2.0": """"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns
Covered Software. "Contributor Version" means the combination of the Contributions of others (if any) used by a
Contributor and that particular Contributor's Contribution. "Contribution" means Covered Software of a particular
Contributor.""",
}
MAP = 20


def known_templates() -> list[tuple[str, str]]:
    """(name, text) of all templates, in name order."""
    out = [(n, f"{p} {t}") for n, t in NAMES.items() for p in PHRASES]
    out += [*TEXTS.items(), *OPENINGS.items()]
    out += [(n, FREE_SOFTWARE.format(what=w, kind=kind, version=v)) for n, (kind, v) in GNU_KINDS.items() for w in ("This program", "This library")]
    out += [(n, t.format(kind=kind, code=code)) for n, (kind, code) in CREATIVE_KINDS.items() for t in (CREATIVE, CREATIVE_CODE)]
    return sorted(dict.fromkeys(out))


class Templates:
    """Bigrams of all templates: size of each, the bounds that prune, and which templates have a bigram how often."""

    def __init__(self, threshold: float, templates: list[tuple[str, str]] | None = None) -> None:
        known = [(n, _bigrams(t)) for n, t in (known_templates() if templates is None else sorted(templates))]
        known = [(n, g) for n, g in known if len(g)]
        self.threshold = threshold
        self.names = [n for n, _ in known]
        self.size = np.array([len(g) for _, g in known], np.int64)
        self.least = np.ceil(self.size * threshold / (2 - threshold) - 1e-9).astype(np.int64)
        self.most = np.floor(self.size * (2 - threshold) / threshold + 1e-9).astype(np.int64)
        self.common = np.ceil(threshold / 2 * (self.least + self.size) - 1e-9).astype(np.int64)
        every = np.concatenate([g for _, g in known]) if known else np.zeros(0, np.uint64)
        self.bigram, at = np.unique(every, return_inverse=True)
        pair, self.often = np.unique(at * len(known) + np.repeat(np.arange(len(known)), self.size), return_counts=True)
        self.owner = pair % max(1, len(known))
        self.first = np.searchsorted(pair // max(1, len(known)), np.arange(len(self.bigram) + 1))
        self.map = np.zeros(1 << MAP, bool)
        self.map[(self.bigram >> np.uint64(64 - MAP)).astype(np.int64)] = True

    def look_up(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose bigram some template has, and its number."""
        pos = np.flatnonzero(self.map[(g >> np.uint64(64 - MAP)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.bigram, g[pos]), len(self.bigram) - 1)
        real = self.bigram[k] == g[pos]
        return pos[real], k[real]


def _bigrams(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return grams(words(raw, np.array([0, len(raw)]), PUNCT)[0], 2)


def passages(pos: np.ndarray, kind: np.ndarray, often: np.ndarray, size: int, most: int, common: int, threshold: float) -> list[tuple[float, int, int]]:
    """(Dice, start, end) of the best passage from each start that reaches the threshold.

    pos, kind: ascending places of the template's bigrams in a text, and which; often: how often the template has each.
    """
    start = np.flatnonzero(np.searchsorted(pos, pos + most) - np.arange(len(pos)) >= common)
    if not len(start):
        return []
    # a bigram counts in a passage unless the template's number of it is used up by earlier ones there
    order = np.argsort(kind, kind="stable")
    rank = np.arange(len(pos))
    spent = np.full(len(pos), -1)
    back = rank - often[order]
    same = (back >= 0) & (kind[order[np.maximum(back, 0)]] == kind[order])
    spent[order[same]] = order[back[same]]
    wide = int((np.searchsorted(pos, pos[start] + most) - start).max())
    out = []
    for lo in range(0, len(start), max(1, (1 << 20) // wide)):
        s = start[lo : lo + max(1, (1 << 20) // wide)]
        q = s[:, None] + np.arange(wide)[None, :]
        inside = q < len(pos)
        q = np.minimum(q, len(pos) - 1)
        length = pos[q] - pos[s][:, None] + 1
        inside &= length <= most
        both = np.cumsum(inside & (spent[q] < s[:, None]), axis=1)
        dice = np.where(inside, 2 * both / (length + size), 0.0)
        best = dice.argmax(1)
        top = dice[np.arange(len(s)), best]
        for i in np.flatnonzero(top >= threshold - 1e-12):
            out.append((float(top[i]), int(pos[s[i]]), int(pos[q[i, best[i]]]) + 1))
    return out


def apart(found: list[tuple[float, int, int, int]]) -> tuple[float, int, int]:
    """Best Dice, its template and the number of passages (Dice, template, start, end) taken best first without overlap."""
    best, kind, starts, ends = 0.0, -1, [], []
    for d, k, lo, hi in sorted(found, key=lambda f: (-round(f[0], 9), f[2] - f[3], *f[1:])):
        i = bisect.bisect_right(starts, lo)
        if (i and ends[i - 1] > lo) or (i < len(starts) and starts[i] < hi):
            continue
        starts.insert(i, lo)
        ends.insert(i, hi)
        if kind < 0:
            best, kind = d, k
    return best, kind, len(starts)


def scan(t: Templates, text: pa.Array) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    data, off = buffers(text)
    n = len(off) - 1
    name: list[str | None] = [None] * n
    dice, many = np.zeros(n), np.zeros(n, np.int32)
    kinds = len(t.names)
    for a, z in row_blocks(off):
        h, row, _, _ = words(data[off[a] : off[z]], off[a : z + 1] - off[a], PUNCT)
        if len(h) < 2 or not kinds:
            continue
        pos, which = t.look_up(grams(h, 2))
        real = row[pos] == row[pos + 1]
        pos, which = pos[real], which[real]
        each = t.first[which + 1] - t.first[which]
        hit = np.repeat(np.arange(len(pos)), each)
        entry = np.repeat(t.first[which], each) + np.arange(len(hit)) - np.repeat(np.cumsum(each) - each, each)
        key = row[pos[hit]] * kinds + t.owner[entry]
        order = np.argsort(key, kind="stable")
        key, hit, entry = key[order], hit[order], entry[order]
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)
        found: dict[int, list] = {}
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            r, k = divmod(int(key[lo]), kinds)
            if hi - lo < t.common[k]:
                continue
            got = passages(pos[hit[lo:hi]], which[hit[lo:hi]], t.often[entry[lo:hi]], int(t.size[k]), int(t.most[k]), int(t.common[k]), t.threshold)
            if got:
                found.setdefault(r, []).extend((d, k, x, y) for d, x, y in got)
        for r, f in found.items():
            dice[a + r], k, many[a + r] = apart(f)
            name[a + r] = t.names[k]
    return name, dice, many


def scan_licenses(docs: DataFrame, threshold: float = 0.8, keep: list[str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """docs with license, dice and n_matches; no shuffle."""
    made: list[Templates] = []

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        if not made:
            made.append(Templates(threshold, templates))
        name, dice, many = scan(made[0], b.column(b.schema.get_field_index("text")))
        return [pa.array(name, pa.string()), pa.array(dice), pa.array(many)]

    return add_columns(docs, make, [("license", T.StringType()), ("dice", T.DoubleType()), ("n_matches", T.IntegerType())], keep)


def op4_license_scan(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs.select("doc_id", "text"), keep=["doc_id"]).withColumn("dice", F.round("dice", 9))
