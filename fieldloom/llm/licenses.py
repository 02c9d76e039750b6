"""License texts in documents by patience alignment.

A stretch of text is aligned with a template: words that occur once in both are anchors, the longest increasing run of them is kept, and the
gaps between are aligned the same way. The share of the template's words that are aligned is its coverage. Stretches where a template's own
words stand close together are aligned first; what is left of the text on either side of a find is then aligned from each word that would
begin the template anew to the next, and at last as one, however many other words stand between; only stretches with too few of the
template's words to reach the least coverage are passed over. A template's deciding words (name, version, clause words) must be aligned too, and no other word may stand between those of one
phrase, so that a notice of another license or version does not pass by its coverage. Texts without any template's deciding words are
passed over at once.

Defined results: null and empty texts have no spans; repeated rows give equal spans; spans of one template do not overlap, and of those
that overlap between templates the one with more aligned words stays, then the higher coverage, then the first template by name;
an empty table gives an empty table; whole texts are read, however long; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame

from fieldloom.llm.common import text_of

#: Share of a template's words that a span must align.
LEAST_COVERAGE = 0.8
#: Words between two of a template's own words, at most, in the stretches that are tried first.
GAP = 12
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

# License notices and the openings of license texts. Whole texts are in license_texts.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
TEMPLATES |= {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "bsd-2-clause": "Released under the BSD 2-Clause License.",
    "bsd-3-clause": "Released under the BSD 3-Clause License.",
    "bsd-notice": "Released under the BSD License.",
    "cc0-1.0": "Licensed under CC0 1.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
}
for _name, _family, _version in (("gpl-2.0", "", "2"), ("lgpl-2.1", "Lesser ", "2.1"), ("lgpl-3.0", "Lesser ", "3"), ("agpl-3.0", "Affero ", "3")):
    _header = TEMPLATES["gpl-header"].replace("GNU General", f"GNU {_family}General").replace("version 3", f"version {_version}")
    TEMPLATES[f"{_name}-header"] = _header
_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
for _code, _long in _CC.items():
    for _version, _scope in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        TEMPLATES[f"cc-{_code}-{_version}"] = f"Licensed under CC {_code.upper()} {_version}."
        TEMPLATES[f"cc-{_code}-{_version}-notice"] = f"This work is licensed under a Creative Commons {_long} {_version} {_scope} License."
TEMPLATES |= {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in resources.files("fieldloom.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")}
TEMPLATES["json"] = TEMPLATES["mit-full"].replace("\n\nTHE SOFTWARE", "\n\nThe Software shall be used for Good, not Evil.\n\nTHE SOFTWARE")

#: Phrases of each template that must be aligned with no word but FILLER between theirs.
DECIDING = {
    "0bsd-text": ["hereby granted the software is provided"],
    "agpl-3.0": ["gnu affero general public license version 3"],
    "agpl-3.0-header": ["gnu affero general public license", "version 3 of license"],
    "apache-2.0": ["apache 2"],
    "apache-2.0-header": ["apache 2"],
    "apache-2.0-text": ["apache license", "grant of patent license", "submission of contributions"],
    "bsd": ["redistributions of source code must retain"],
    "bsd-2-clause": ["bsd 2 clause"],
    "bsd-2-clause-text": ["provided with the distribution this software is provided"],
    "bsd-3-clause": ["bsd 3 clause"],
    "bsd-3-clause-text": ["endorse or promote products"],
    "bsd-4-clause-text": ["endorse or promote products", "advertising materials mentioning"],
    "bsd-notice": ["bsd license"],
    "bsl-1.0-text": ["machine executable object code"],
    "cc0-1.0": ["cc0 1"],
    "cc0-1.0-text": ["cc0 1"],
    "gpl-2.0": ["gnu general public 2"],
    "gpl-2.0-header": ["gnu general public", "2 of license"],
    "gpl-2.0-text": ["gnu general public license is intended", "gnu general public license version 2 june 1991"],
    "gpl-3.0": ["gnu general public 3"],
    "gpl-3.0-text": ["gnu general public license is a free"],
    "gpl-header": ["gnu general public", "3 of license"],
    "isc": ["with or without fee", "and this permission notice appear in all copies"],
    "isc-text": ["with or without fee", "and this permission notice appear in all copies"],
    "json": ["good not evil"],
    "lgpl-2.1": ["gnu lesser general public 2.1"],
    "lgpl-2.1-header": ["gnu lesser general public", "2.1 of license"],
    "lgpl-2.1-text": ["gnu lesser general public", "version 2.1 february 1999"],
    "lgpl-3.0": ["gnu lesser general public 3"],
    "lgpl-3.0-header": ["gnu lesser general public", "3 of license"],
    "lgpl-3.0-text": ["gnu lesser general public 3"],
    "mit": ["mit license"],
    "mit-full": ["permission notice shall be included in all copies", "substantial portions of the software the software is provided"],
    "mit-text": ["permission notice shall be included in all copies"],
    "mpl-2.0": ["mozilla public 2"],
    "mpl-2.0-text": ["mozilla public 2"],
    "unlicense-text": ["free and unencumbered software"],
    "zlib-text": ["origin of this software must not be misrepresented"],
}
for _code, _long in _CC.items():
    for _version in ("2", "2.5", "3", "4"):
        _full = _version if "." in _version else f"{_version}.0"
        DECIDING[f"cc-{_code}-{_full}"] = [f"cc {_code.replace('-', ' ')} {_version}"]
        DECIDING[f"cc-{_code}-{_full}-notice"] = [f"creative commons {_long.replace('-', ' ').lower()} {_version}"]
FILLER = {"version", "v", "license", "licence", "the"}
COMMON = set("a above all an and any are as at be by can copy either for form free from if in included is it law later may met must not of on one option or other person that the this to under use was with without work you".split())


def normal(word: str) -> str:
    """In lower case; a version without its v and its last zeros."""
    word = word.lower()
    if word[-1].isdigit() and (m := re.fullmatch(r"v?([0-9]+(?:\.[0-9]+)*?)(?:\.0)*", word)):
        return m[1]
    return word


def words_of(text: str) -> list[str]:
    return [normal(m.group()) for m in _WORD.finditer(text)]


def phrase_places(phrase: list[str], template: list[str]) -> list[list[int]]:
    """Where the template has the phrase's words in order with nothing but FILLER between."""
    out = []
    for at in (i for i, w in enumerate(template) if w == phrase[0]):
        places = [at]
        for word in phrase[1:]:
            at += 1
            while at < len(template) and template[at] != word and template[at] in FILLER:
                at += 1
            if at == len(template) or template[at] != word:
                break
            places.append(at)
        if len(places) == len(phrase):
            out.append(places)
    return out


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by their first, whose second increase too."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        back.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(y)
            at.append(i)
        else:
            tails[k], at[k] = y, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs of places with equal words, increasing in both."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(template[c:d], c) if there[w] == 1}
        anchors = increasing([(i, place[w]) for i, w in enumerate(text[a:b], a) if here[w] == 1 and w in place])
        out += anchors
        if anchors:
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            todo += [(x + 1, z, y + 1, w) for (x, y), (z, w) in zip(edges, edges[1:]) if z > x + 1 and w > y + 1]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], least: float = LEAST_COVERAGE, deciding: dict[str, list[str]] | None = None):
        self.least = least
        deciding = DECIDING if deciding is None else deciding
        self.templates = {name: words_of(text) for name, text in sorted(templates.items())}
        self.counts = {name: Counter(words) for name, words in self.templates.items()}
        self.own = {name: set(words) - COMMON for name, words in self.templates.items()}
        # Another text under a known name is held to its coverage alone.
        phrases = {name: [p.split() for p in deciding.get(name, ())] if templates[name] == TEMPLATES.get(name) else [] for name in self.templates}
        self.phrases = {name: [phrase_places(p, self.templates[name]) for p in phrases[name]] for name in self.templates}
        self.needed = {name: {w for p in phrases[name] for w in p} for name in self.templates}
        # A word that every text with the template has; without deciding words, any of its own.
        picks = [{max(needed, key=lambda w: (w.isalpha(), len(w), w))} if needed else self.own[name] for name, needed in self.needed.items()]
        marks = set().union(*picks)
        self.mark = re.compile("|".join(sorted(map(re.escape, marks), key=len, reverse=True))) if marks else None

    def decided(self, name: str, words: list[str], pairs: list[tuple[int, int]]) -> bool:
        """Whether each deciding phrase is aligned somewhere with no word but FILLER between its words."""
        at = {c: a for a, c in pairs}

        def whole(places: list[int]) -> bool:
            if any(p not in at for p in places):
                return False
            return all(words[i] in FILLER for p, q in zip(places, places[1:]) for i in range(at[p] + 1, at[q]))

        return all(any(map(whole, found)) for found in self.phrases[name])

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, aligned words, begin, end) with places in characters, by begin."""
        if not self.mark or not self.mark.search(text.lower()):
            return []
        found = list(_WORD.finditer(text))
        words = [normal(m.group()) for m in found]
        present = set(words)
        chosen = [name for name, needed in self.needed.items() if needed <= present]
        if not chosen:
            return []
        where: dict[str, list[int]] = {}
        marked = set().union(*(self.counts[name] for name in chosen))
        for i, w in enumerate(words):
            if w in marked:
                where.setdefault(w, []).append(i)
        spans = []
        for name in chosen:
            for a, b, aligned, coverage in self.found(name, words, where):
                spans.append((name, coverage, aligned, found[a].start(), found[b - 1].end()))
        kept: list[tuple[str, float, int, int, int]] = []
        for span in sorted(spans, key=lambda s: (-s[2], -s[1], s[0])):
            # Kept spans do not overlap and stand in order: only the neighbours can meet this one.
            k = bisect_left(kept, span[3], key=lambda s: s[3])
            if (k == 0 or kept[k - 1][4] <= span[3]) and (k == len(kept) or span[4] <= kept[k][3]):
                kept.insert(k, span)
        return kept

    def found(self, name: str, words: list[str], where: dict[str, list[int]]) -> list[tuple[int, int, int, float]]:
        """Spans (first word, last word + 1, aligned words, coverage) of one template, none over another."""
        template, own, counts = self.templates[name], self.own[name], self.counts[name]
        out: list[tuple[int, int, int, float]] = []

        def enough(lo: int, hi: int) -> bool:
            """Whether these words could be aligned with the least share of the template at all."""
            held = 0
            for w, n in counts.items():
                at = where.get(w, ())
                i = bisect_left(at, lo)
                some = min(n, bisect_left(at, hi) - i)
                if not some and w in self.needed[name]:
                    return False
                held += some
            return held >= self.least * len(template)

        def tried(lo: int, hi: int) -> bool:
            if not enough(lo, hi):
                return False
            pairs = align(words[lo:hi], template)
            coverage = len(pairs) / len(template)
            if coverage < self.least or not self.decided(name, words[lo:hi], pairs):
                return False
            # A common word far before or behind is not part of the span.
            first, last = 0, len(pairs) - 1
            while first < last and pairs[first + 1][0] - pairs[first][0] > GAP and template[pairs[first][1]] in COMMON:
                first += 1
            while first < last and pairs[last][0] - pairs[last - 1][0] > GAP and template[pairs[last][1]] in COMMON:
                last -= 1
            out.append((lo + pairs[first][0], lo + pairs[last][0] + 1, len(pairs), coverage))
            return True

        places = sorted(i for w in own for i in where.get(w, ()))
        for group in self._places(places, words, own, counts, GAP):
            tried(max(0, group[0] - GAP, out[-1][1] if out else 0), min(len(words), group[-1] + GAP + 1))
        todo = list(zip([0, *(b for _, b, _, _ in out)], [*(a for a, _, _, _ in out), len(words)], strict=True))
        while todo:
            lo, hi = todo.pop()
            if not enough(lo, hi):
                continue
            inside = places[bisect_left(places, lo) : bisect_left(places, hi)]
            groups = self._places(inside, words, own, counts, hi)
            ends = [*(g[0] for g in groups[1:]), hi]
            for begin, end in [*(zip([lo, *ends], ends, strict=False) if len(groups) > 1 else ()), (lo, hi)]:
                if tried(begin, end):
                    todo += [(lo, out[-1][0]), (out[-1][1], hi)]
                    break
        return out

    @staticmethod
    def _places(places: list[int], words: list[str], own: set[str], counts: Counter, gap: int) -> list[list[int]]:
        """Runs of places at most ``gap`` apart; a run ends before a word that would begin the template anew. Only those with half its own words."""
        out, held, seen = [], [], Counter()
        for i in places:
            if held and (i - held[-1] > gap or (len(seen) == len(own) and seen[words[i]] >= counts[words[i]])):
                out.append((held, len(seen)))
                held, seen = [], Counter()
            held.append(i)
            seen[words[i]] += 1
        out.append((held, len(seen)))
        return [h for h, n in out if h and 2 * n >= len(own)]


def scan_documents(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, n_spans, license (of the span with most aligned words; null if none), coverage, spans."""
    templates = TEMPLATES if templates is None else templates
    span = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("begin", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            found = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            top = [max(f, key=lambda s: (s[2], s[1], -s[3]), default=None) for f in found]
            columns = [
                batch.column(0).cast(pa.int64()),
                pa.array([len(f) for f in found], pa.int64()),
                pa.array([t and t[0] for t in top], pa.string()),
                pa.array([t[1] if t else 0.0 for t in top], pa.float64()),
                pa.array([[{"license": s[0], "coverage": s[1], "begin": s[3], "end": s[4]} for s in f] for f in found], pa.list_(span)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_spans", "license", "coverage", "spans"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, n_spans long, license string, coverage double, spans array<struct<license: string, coverage: double, begin: int, end: int>>")
