"""License scan: winnowed template fingerprints, an inverted index, banded alignment.

Templates are cut into words (letters and digits, lower case) and runs of GRAM words; from every
WINDOW runs in a row the smallest hash is kept (winnowing), so a text that shares
GRAM + WINDOW - 1 words in a row with a template shares a kept hash. The inverted index maps
hashes to templates and places. A text's kept hashes are looked up there; hits of one template
on nearby diagonals make a candidate, and a band around them is aligned word by word
(Needleman-Wunsch along the band, free ends in the text). Matched words over the words of the
template are the coverage.

Templates are whole license texts, standard headers, one-line notices and SPDX tags. A name is
reported only if the deciding words agree as well (version, NonCommercial, Lesser, a clause).

Templates are a parameter of bounded size, so their index goes to the tasks, and documents never
move. More templates than MAX_WORDS words are taken in several passes over the documents, each
with a part of them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.llm.license_texts import FULL
from loanweave.llm.store import ship
from loanweave.llm.text import by_bytes, mixed

GRAM, WINDOW = 3, 3
BAND = 8
LEAST_COVERAGE = 0.8
MAX_WORDS = 2_000_000
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
VERSION = re.compile(r"^v?(\d+(?:\.\d+)*?)(?:\.0)?$")

# License texts, standard headers and notices as their publishers word them.
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
    "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
    "and associated documentation files (the \"Software\"), to deal in the Software without "
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so")
_MIT_NOTICE = (
    ", subject to the following conditions: The above copyright notice and this permission notice "
    "shall be included in all copies or substantial portions of the Software. ")
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: 1. Redistributions of source code must retain the "
    "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions "
    "in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_ADS = (
    "3. All advertising materials mentioning features or use of this software must display the "
    "following acknowledgement: This product includes software developed by the copyright holder. ")
_BSD_NAMES = (
    "{}. Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written permission. ")
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
    "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
    "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
    "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
    "fee is hereby granted")
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_WARRANTY = (
    ". THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE "
    "OF THIS SOFTWARE.")


def _gnu(what: str, name: str, version: str, later: bool) -> str:
    """The header that the Free Software Foundation asks for, up to the address."""
    which = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version}"
    return (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the "
        f"GNU {name} as published by the Free Software Foundation, {which}. This {what} is distributed "
        "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
        f"of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
        f"You should have received a copy of the GNU {name} along with this {what}")


_GNU = {
    "gpl": ("program", "General Public License", ("1", "2", "3")),
    "lgpl-2.0": ("library", "Library General Public License", ("2",)),
    "lgpl": ("library", "Lesser General Public License", ("2.1", "3")),
    "agpl": ("program", "Affero General Public License", ("3",)),
}
_CC = {
    "by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives",
    "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
    "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0-Perl "
    "Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC0-1.0 "
    "CC-BY-3.0 CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 "
    "CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 "
    "GFDL-1.2-or-later GFDL-1.3-or-later GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 "
    "GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only "
    "LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL "
    "MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 SSPL-1.0 Unicode-3.0 "
    "Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1").split()

TEMPLATES = {
    **FULL,
    "mit": _MIT_GRANT + _MIT_NOTICE + _WARRANTY,
    "mit-0": _MIT_GRANT + ". " + _WARRANTY,
    "x11": _MIT_GRANT + _MIT_NOTICE + _WARRANTY + (
        " Except as contained in this notice, the name of the copyright holders shall not be used in "
        "advertising or otherwise to promote the sale, use or other dealings in this Software without "
        "prior written authorization from the copyright holders."),
    "bsd-2-clause": _BSD_TWO + _BSD_WARRANTY,
    "bsd-3-clause": _BSD_TWO + _BSD_NAMES.format(3) + _BSD_WARRANTY,
    "bsd-4-clause": _BSD_TWO + _BSD_ADS + _BSD_NAMES.format(4) + _BSD_WARRANTY,
    "isc": _ISC_GRANT + _ISC_NOTICE + _ISC_WARRANTY,
    "0bsd": _ISC_GRANT + _ISC_WARRANTY,
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the "
        "authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and "
        "to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. 2. Altered source versions must be plainly marked as "
        "such, and must not be misrepresented as being the original software. 3. This notice may not be "
        "removed or altered from any source distribution."),
    "bsl-1.0": (
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of "
        "charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software, and to "
        "permit third-parties to whom the Software is furnished to do so, all subject to the following: "
        "The copyright notices in the Software and this entire statement, including the above license "
        "grant, this restriction and the following disclaimer, must be included in all copies of the "
        "Software, in whole or in part, and all derivative works of the Software, unless such copies or "
        "derivative works are solely in the form of machine-executable object code generated by a source "
        "language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE "
        "DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
        "modify, publish, use, compile, sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In "
        "jurisdictions that recognize copyright laws, the author or authors of this software dedicate any "
        "and all copyright interest in the software to the public domain. We make this dedication for the "
        "benefit of the public at large and to the detriment of our heirs and successors. We intend this "
        "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to "
        "this software under copyright law. " + _WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")),
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
        "the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "epl-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse "
        "Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    "epl-1.0-header": (
        "All rights reserved. This program and the accompanying materials are made available under the "
        "terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at "
        "http://www.eclipse.org/legal/epl-v10.html"),
    **{f"{k if v in k else f'{k}-{v}' if '.' in v else f'{k}-{v}.0'}-{'or-later' if later else 'only'}-header":
       _gnu(what, name, v, later)
       for k, (what, name, versions) in _GNU.items() for v in versions for later in (False, True)},
    "mit-line": "Released under the MIT License.",
    "isc-line": "Released under the ISC License.",
    "bsd-2-clause-line": "Released under the BSD 2-Clause License.",
    "bsd-3-clause-line": "Released under the BSD 3-Clause License.",
    "mpl-2.0-line": "Licensed under the Mozilla Public License, Version 2.0.",
    "epl-2.0-line": "Licensed under the Eclipse Public License, Version 2.0.",
    "cc0-1.0-line": "Licensed under CC0 1.0 Universal.",
    **{f"{k}-{v if '.' in v else v + '.0'}-line": f"This work is licensed under the GNU {name}, version {v}."
       for k, name, versions in (("gpl", "General Public License", "2 3"), ("lgpl", "Lesser General Public License", "2.1 3"),
                                 ("agpl", "Affero General Public License", "3")) for v in versions.split()},
    **{f"cc-{k}-{v}-short-line" if (k, v) != ("by-nc", "4.0") else "cc-by-nc-4.0-line": f"Licensed under CC {k.upper()} {v}."
       for k in _CC for v in ("3.0", "4.0")},
    **{f"cc-{k}-{v}-{'long-' if (k, v) == ('by-nc', '4.0') else ''}line":
       f"This work is licensed under a Creative Commons {name} {v} {where} License."
       for k, name in _CC.items() for v, where in (("3.0", "Unported"), ("4.0", "International"))},
    **{f"spdx-{i.lower()}": f"SPDX-License-Identifier: {i}" for i in SPDX},
}

# Words and pairs of words that tell licenses apart: a notice must hold the same as its template.
DECIDING = {w: w for w in (
    "mit isc bsd apache mozilla mpl eclipse epl gpl lgpl agpl cc0 sharealike noncommercial noderivatives "
    "later affero_general lesser_general library_general gnu_general").split()} | {
    "sa": "sharealike", "share_alike": "sharealike", "nc": "noncommercial", "non_commercial": "noncommercial",
    "nd": "noderivatives", "no_derivatives": "noderivatives", "noderivs": "noderivatives", "no_derivs": "noderivatives"}
# Whole texts that hold others or differ in a clause: what must and what must not be there.
NEEDS = {
    "mit": "permission_notice", "x11": "permission_notice in_advertising", "isc": "permission_notice",
    "bsd-3-clause": "or_promote", "bsd-4-clause": "or_promote advertising_materials",
    "gfdl-1.3": "massive_multiauthor", "gpl-3.0": "gnu_general", "lgpl-2.0": "library_general",
    "lgpl-2.1": "lesser_general", "cc-by-sa-4.0": "sharealike",
}
BARS = {
    "mit-0": "permission_notice", "0bsd": "permission_notice", "bsd-2-clause": "or_promote",
    "bsd-3-clause": "advertising_materials", "gfdl-1.2": "massive_multiauthor", "gpl-3.0": "remote_network",
    "lgpl-2.0": "lesser_general", "cc-by-sa-4.0": "noncommercial",
}
_SPDX_NAMES = {i.lower() for i in SPDX}
LONG = 100  # words from which a template is a text, not a notice


def words_of(text: str) -> tuple[list[str], list[int]]:
    """Words in lower case, versions without v and .0, and the character at which each starts."""
    words, spans = spanned_words(text)
    return words, [a for a, _ in spans]


def spanned_words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(WORD.finditer(text))
    words = [m.group().lower() for m in found]
    return [VERSION.sub(r"\1", w) if w[-1].isdigit() else w for w in words], [m.span() for m in found]


def signs(words: list[str]) -> set[str]:
    """The words and the pairs of words that follow each other, under their names in DECIDING."""
    return {DECIDING.get(w, w) for w in [*words, *map("_".join, zip(words, words[1:]))]}


def decided(name: str, template: list[str], text: list[str], around: list[str]) -> bool:
    """Whether a part of a text holds what tells this template from others, and the part with
    what may stand in place of unmatched words does not hold what tells others."""
    found = signs(text)
    if name.startswith("spdx-") and name[5:] in _SPDX_NAMES:
        return template[-1] == text[-1] and set(template) == set(text)
    if len(template) >= LONG or name in NEEDS or name in BARS:
        return set(NEEDS.get(name, "").split()) <= found and not set(BARS.get(name, "").split()) & signs(around)
    wanted, known = signs(template), set(DECIDING.values())
    numbers = {w for w in template if w.replace(".", "").isdigit()}
    return wanted & known == found & known and numbers <= found


def numbers_of(words: list[str]) -> np.ndarray:
    """A 64-bit number for each word, the same on every machine."""
    seen: dict[str, int] = {}
    for w in words:
        if w not in seen:
            h = 0xCBF29CE484222325
            for b in w.encode():
                h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
            seen[w] = h
    return mixed(np.array([seen[w] for w in words], np.uint64))


def grams(numbers: np.ndarray) -> np.ndarray:
    n = len(numbers) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(GRAM):
        out = out * np.uint64(0xD6E8FEB86659FD93) + numbers[i : i + n]
    return mixed(out)


def winnowed(numbers: np.ndarray) -> np.ndarray:
    """Places of the kept runs: the smallest hash of each window, the rightmost of equals."""
    h = grams(numbers)
    if not len(h):
        return np.zeros(0, np.int64)
    if len(h) <= WINDOW:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(h, WINDOW)[:, ::-1]
    return np.unique(np.arange(len(views)) + WINDOW - 1 - views.argmin(axis=1))


def band_of(words: int) -> int:
    """Words by which an alignment may leave its diagonal: a sixth of the template, BAND at most,
    or a 32nd of a long one."""
    return max(1, min(max(BAND, words // 32), words // 6))


def aligned(template: np.ndarray, text: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """Most words that match in order within a band of the diagonal (text place - template place),
    and the first and one past the last matched place in the text."""
    m = len(template)
    if diagonal >= 0 and np.array_equal(text[diagonal : diagonal + m], template):
        return m, diagonal, diagonal + m
    band = band_of(m)
    width = 2 * band + 1
    score = np.zeros(width, np.int64)
    begin = np.full(width, -1, np.int64)
    end = np.full(width, -1, np.int64)
    cells = np.arange(width)
    for i in range(m):
        place = i + diagonal + cells - band
        inside = (place >= 0) & (place < len(text))
        hit = inside & (text[np.clip(place, 0, max(len(text) - 1, 0))] == template[i])
        # Skipping a template word moves one cell up the band (text place stays).
        up = np.concatenate([score[1:], [-1]])
        diag = score + hit
        best = np.maximum(diag, up)
        from_up = up > diag
        begin = np.where(from_up, np.concatenate([begin[1:], [-1]]), np.where(hit & (begin < 0), place, begin))
        end = np.where(from_up, np.concatenate([end[1:], [-1]]), np.where(hit, place + 1, end))
        score = best
        # Skipping a text word moves one cell down: each cell takes the best so far.
        top = np.maximum.accumulate(score)
        source = np.maximum.accumulate(np.where(score == top, cells, 0))
        score, begin, end = top, begin[source], end[source]
    c = int(score.argmax())
    return int(score[c]), int(begin[c]), int(end[c])


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known ones, which are sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Index:
    """Inverted index of the kept hashes of templates."""

    def __init__(self, templates: Mapping[str, str]):
        self.names, self.words, self.numbers, self.counts, self.postings = [], [], [], [], defaultdict(list)
        for name, text in templates.items():
            words = words_of(text)[0]
            numbers = numbers_of(words)
            if len(numbers) < GRAM:
                continue
            h = grams(numbers)
            # Every run of a template is listed: a text's kept run may be any of them.
            for place in range(len(h)):
                self.postings[int(h[place])].append((len(self.names), place))
            self.names.append(name)
            self.words.append(words)
            self.numbers.append(numbers)
            self.counts.append(np.unique(numbers, return_counts=True))
        self.hashes = np.array(sorted(self.postings), np.uint64)
        self.short = np.unique(np.concatenate([np.zeros(0, np.uint64), *(
            grams(n) for n in self.numbers if len(n) < 2 * (GRAM + WINDOW - 1))]))

    def common(self, template: int, numbers: np.ndarray) -> int:
        """How many words a text and a template share in any order: no alignment matches more."""
        words, counts = self.counts[template]
        at = np.minimum(np.searchsorted(words, numbers), len(words) - 1)
        found = np.bincount(at[words[at] == numbers], minlength=len(words))
        return int(np.minimum(found, counts).sum())

    def candidates(self, numbers: np.ndarray, least: float = 0.0) -> list[tuple[int, int]]:
        """(template, diagonal) that may reach the coverage, nearby diagonals put together."""
        h = grams(numbers)
        if not len(h) or not len(self.hashes):
            return []
        # Runs of short templates are all looked up: few words need not share a kept one.
        kept = np.union1d(winnowed(numbers), np.flatnonzero(_among(h, self.short)))
        h = h[kept]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hits = defaultdict(lambda: defaultdict(int))
        for place, value in zip(kept[self.hashes[at] == h].tolist(), h[self.hashes[at] == h].tolist()):
            for template, there in self.postings[value]:
                hits[template][place - there] += 1
        out = []
        for template, diagonals in hits.items():
            m = len(self.numbers[template])
            if len(numbers) < least * m or (m >= LONG and self.common(template, numbers) < least * m):
                continue
            band, groups = band_of(m), []
            for d in sorted(diagonals):
                if not groups or d > groups[-1][0] + band:
                    groups.append([])
                groups[-1].append(d)
            # The diagonal with most hits stands for those near it.
            for d in sorted((max(group, key=diagonals.get) for group in groups), key=lambda d: -diagonals[d]):
                part = numbers[max(0, d - band) : max(0, d + m + band)]
                if len(part) >= least * m and self.common(template, part) >= least * m:
                    out.append((template, d))
        return out

    def matches(self, text: str, least: float) -> list[tuple[str, int, float, int, int]]:
        """(template, matched words, coverage, first character, one past the last) of each place
        that reaches the coverage; of overlapping places of one template the best."""
        words, spans = spanned_words(text)
        numbers = numbers_of(words)
        found, whole = [], []
        for template, diagonal in self.candidates(numbers, least):
            wanted = self.numbers[template]
            m, band = len(wanted), band_of(len(wanted))
            # Beside a whole copy there must be room for another place.
            if any(t == template and max(b - diagonal + band, diagonal + m + band - e) < least * m for t, b, e in whole):
                continue
            n, begin, end = aligned(wanted, numbers, diagonal)
            if n < least * m:
                continue
            joined = end  # words joined to the last one by a hyphen belong to its name
            while joined < len(words) and text[spans[joined - 1][1] : spans[joined][0]] == "-":
                joined += 1
            more = m - n + 2 * band if n < m else 0
            around = words[max(0, begin - more) : end + more]
            if decided(self.names[template], self.words[template], words[begin:joined], around):
                found.append((self.names[template], n, n / m, begin, end))
                if n == m == end - begin:
                    whole.append((template, begin, end))
        found.sort(key=lambda f: (f[0], -f[1], f[3]))
        kept: list = []
        for f in found:
            if not any(k[0] == f[0] and f[3] < k[4] and k[3] < f[4] for k in kept):
                kept.append(f)
        return [(n, m, c, spans[b][0], spans[e - 1][1]) for n, m, c, b, e in sorted(kept, key=lambda f: (f[3], f[0]))]


def parts(templates: Mapping[str, str]) -> Iterator[dict[str, str]]:
    """The templates in groups of at most MAX_WORDS words (or of one template)."""
    group: dict[str, str] = {}
    size = 0
    for name, text in templates.items():
        n = len(text.split())
        if group and size + n > MAX_WORDS:
            yield group
            group, size = {}, 0
        group[name] = text
        size += n
    if group:
        yield group


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, template, matched_words, coverage, span_start, span_end (characters of the text)
    for each place of a document that covers a template.

    Null and empty texts match nothing. Repeated rows report once each. A text that holds a
    template several times reports every place. Templates of fewer than GRAM words are left out.
    Empty tables, or no templates, give no rows. Only doc_id and text are read.
    """
    ship(docs.sparkSession)
    schema = ("doc_id long, template string, matched_words long, coverage double, "
              "span_start long, span_end long")
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    out = docs.sparkSession.createDataFrame([], schema)
    for group in parts(TEMPLATES if templates is None else templates):
        out = out.unionByName(rows.mapInArrow(_scanner(group, least), schema))
    return out


def _scanner(group: dict[str, str], least: float):
    def run(batches):
        index = Index(group)
        for batch in by_bytes(batches, "text"):
            found: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for match in index.matches(text or "", least):
                    for column, value in zip(found, (doc_id, *match)):
                        column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(found, kinds)],
                names=["doc_id", "template", "matched_words", "coverage", "span_start", "span_end"])

    return run
