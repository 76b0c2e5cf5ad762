"""Licence scans by template markup.

A template is a licence wording with marked regions: ``[[...]]`` may be missing, ``{{a-b}}`` stands
for a to b words of any kind; everything else is mandatory and must stand there word for word.
Templates become one automaton over words, made deterministic as texts demand it. Base phrases are
templates without regions. A text is scanned from every word that can begin a template. Licence texts
are templates in full, so that a text with a clause changed or left out is not accepted.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z. NULL counts as the empty text:
no words, no label, score 0. Rows are neither dropped nor merged.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from meshlens.llm.common import add_columns, words

#: Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: The whole public wordings of these licences, with the regions in which copies may differ.
_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this {{1-3}} and associated documentation files"
    " the {{1-3}} to deal in the {{1-3}} without restriction including without limitation the rights to use copy modify merge"
    " publish distribute sublicense and or sell copies of the {{1-3}} and to permit persons to whom the {{1-3}} is furnished to do so"
    " subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]]"
    " shall be included in all copies or substantial portions of the {{1-3}}"
)
_MIT_DISCLAIMER = (
    "the {{1-3}} is provided as is without warranty of any kind express or implied including but not limited to the warranties of"
    " merchantability fitness for a particular purpose and noninfringement in no event shall {{1-10}} be liable for any claim"
    " damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the"
    " {{1-3}} or the use or other dealings in the {{1-1}}"
)
_BSD_CLAUSES = (
    "redistribution and use [[of this software]] in source and binary forms with or without modification are permitted provided that"
    " the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of"
    " conditions and the following disclaimer [[and]] [[2]] redistributions in binary form must reproduce the above copyright notice"
    " this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_ADVERTS = (
    "all advertising materials mentioning features or use of this software must display the following acknowledgement this product"
    " includes software developed by {{1-20}}"
)
_BSD_NAMES = (
    "neither the name of {{1-10}} nor the names of {{1-3}} contributors may be used to endorse or promote products derived from this"
    " software without specific prior written permission"
)
_BSD_DISCLAIMER = (
    "this software is provided by {{1-10}} as is and any express or implied warranties including but not limited to the implied"
    " warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{1-10}} be liable for any"
    " direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute"
    " goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in"
    " contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if"
    " advised of the possibility of such damage"
)
_ISC = (
    "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided"
    " that the above copyright notice and this permission notice appear in all copies the software is provided as is and {{1-10}}"
    " disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no"
    " event shall {{1-10}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from"
    " loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in"
    " connection with the use or performance of this software"
)
_APACHE_NOTICE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may"
    " obtain a copy of the license at {{1-2}} apache org licenses license 2 0 [[txt]] [[html]] unless required by applicable law or"
    " agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of"
    " any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
)
_GPL_TERMS = (
    "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
)
_GPL_DISCLAIMER = (
    "{{1-3}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of"
    " merchantability or fitness for a particular purpose see the gnu general public license for more details"
)
#: Label and wording: references to a licence first, then whole texts and notices.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license [[version]] 2 0 [[the license]]"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at [[http www]] apache org licenses license 2 0"),
    ("gpl-2.0", "licensed under [[the terms of]] the gnu general public license [[as published by the free software foundation]] [[either]] version 2 [[or [[at your option]] any later version]]"),
    ("gpl-3.0", "licensed under [[the terms of]] the gnu general public license [[as published by the free software foundation]] [[either]] version 3 [[or [[at your option]] any later version]]"),
    ("gpl-3.0", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by 4 0 [[international]] [[license]]"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by nc 4 0 [[international]] [[license]]"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by sa 4 0 [[international]] [[license]]"),
    ("mit-notice", "released under the [[terms of the]] mit license"),
    ("mit-notice", "licensed under the [[terms of the]] mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("all-rights-reserved", "copyright [[c]] {{1-10}} all rights reserved"),
    ("mit-text", f"{_MIT_GRANT} {_MIT_DISCLAIMER}"),
    ("bsd-2-clause", f"{_BSD_CLAUSES} {_BSD_DISCLAIMER}"),
    ("bsd-3-clause", f"{_BSD_CLAUSES} [[and]] [[3]] {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    ("bsd-4-clause", f"{_BSD_CLAUSES} [[3]] {_BSD_ADVERTS} [[and]] [[4]] {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    ("isc", _ISC),
    ("apache-2.0-notice", _APACHE_NOTICE),
    ("gpl-2.0-notice", f"{_GPL_TERMS} either version 2 of the license or [[at your option]] any later version {_GPL_DISCLAIMER}"),
    ("gpl-3.0-notice", f"{_GPL_TERMS} either version 3 of the license or [[at your option]] any later version {_GPL_DISCLAIMER}"),
]
_MARK = re.compile(r"\[\[|\]\]|\{\{(\d+)-(\d+)\}\}|[^\s\[\]{}]+")

#: Stands for every word that no template names.
OTHER = b""
#: Deterministic states an automaton remembers.
MOST_STATES = 1 << 14

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("base_places", T.ArrayType(T.LongType())),
    T.StructField("base_labels", T.ArrayType(T.StringType())),
    T.StructField("notices", T.ArrayType(T.StringType())),
    T.StructField("notice_spans", T.ArrayType(T.LongType())),
]


class Automaton:
    """Token automaton of all templates; its deterministic states are made when first met."""

    def __init__(self, templates: Iterable[tuple[str, bool, str]]):
        self.exact: list[dict[bytes, list[int]]] = []
        self.any: list[list[int]] = []
        self.skip: list[list[int]] = []
        self.ends: dict[int, tuple[str, bool]] = {}
        begins = [self._add(label, base, wording) for label, base, wording in templates]
        self.first = self._closure(begins)
        self.starts = {w for n in self.first for w in self.exact[n]}
        self.words = {w for row in self.exact for w in row}
        self.known: dict[frozenset[int], dict[bytes, frozenset[int]]] = {}

    def _node(self) -> int:
        self.exact.append({})
        self.any.append([])
        self.skip.append([])
        return len(self.exact) - 1

    def _add(self, label: str, base: bool, wording: str) -> int:
        begin = at = self._node()
        opened: list[int] = []
        for mark in _MARK.finditer(wording):
            if mark[0] == "[[":
                opened.append(at)
            elif mark[0] == "]]":
                self.skip[opened.pop()].append(at)
            elif mark[1]:
                least, most = int(mark[1]), int(mark[2])
                path = [at]
                for _ in range(most):
                    path.append(self._node())
                    self.any[path[-2]].append(path[-1])
                at = path[-1]
                for n in path[least:-1]:
                    self.skip[n].append(at)
            else:
                after = self._node()
                self.exact[at].setdefault(mark[0].encode(), []).append(after)
                at = after
        self.ends[at] = (label, base)
        return begin

    def _closure(self, nodes: Iterable[int]) -> frozenset[int]:
        todo, seen = list(nodes), set()
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += self.skip[n]
        return frozenset(seen)

    def step(self, state: frozenset[int], word: bytes) -> frozenset[int]:
        if word not in self.words:
            word = OTHER  # all words that no template names lead to the same state
        row = self.known.get(state)
        if row is None:
            if len(self.known) >= MOST_STATES:
                self.known.clear()  # they are made again when met
            row = self.known[state] = {}
        after = row.get(word)
        if after is None:
            named = [x for n in state for x in self.exact[n].get(word, ())]
            after = row[word] = self._closure(named + [x for n in state for x in self.any[n]])
        return after

    def scan(self, own: list[bytes]) -> tuple[list[int], set[str], list[tuple[int, int, str]]]:
        """Places of base phrases, their labels, and the longest match of each notice at a place."""
        starts, places, labels, notices = self.starts, [], set(), []
        for i in [i for i, w in enumerate(own) if w in starts]:
            state, longest = self.first, {}
            for j in range(i, len(own)):
                state = self.step(state, own[j])
                if not state:
                    break
                for n in state & self.ends.keys():
                    label, base = self.ends[n]
                    if base:
                        places.append(i)
                        labels.add(label)
                    else:
                        longest[label] = j + 1
            notices += [(i, end, label) for label, end in sorted(longest.items())]
        return places, labels, notices


@functools.lru_cache(maxsize=2)
def automaton(templates: tuple[tuple[str, bool, str], ...]) -> Automaton:
    """The automaton of templates, made once per Python worker with the states it learns."""
    return Automaton(templates)


def scan(
    docs: DataFrame,
    text: str = "text",
    phrases: dict[str, str] | None = None,
    templates: list[tuple[str, str]] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``n_words``, ``base_places`` (start words), ``base_labels``, ``notices``, ``notice_spans``.

    ``notices`` are the labels of matched templates and ``notice_spans`` their word ranges (flat),
    by place. Columns of these names are replaced. ``keep``: input columns to keep (default: all).
    """
    marked = [(label, True, p) for p, label in (PHRASES if phrases is None else phrases).items()]
    marked += [(label, False, t) for label, t in (TEMPLATES if templates is None else templates)]
    fixed = tuple(marked)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        made = automaton(fixed)
        rows = []
        for value in batch.column(text).to_pylist():
            own = words(value)
            places, labels, notices = made.scan(own)
            spans = [x for start, end, _ in notices for x in (start, end)]
            rows.append((len(own), places, sorted(labels), [label for _, _, label in notices], spans))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()))
        return [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]

    return add_columns(docs, FIELDS, run, keep)


def as_regex(wording: str) -> str:
    """A template as a regular expression over words that each have a space after them."""
    out = []
    for mark in _MARK.finditer(wording):
        if mark[0] == "[[":
            out.append("(?:")
        elif mark[0] == "]]":
            out.append(")?")
        else:
            out.append(rf"(?:[^ ]+ ){{{mark[1]},{mark[2]}}}" if mark[1] else mark[0] + " ")
    return "".join(out)
