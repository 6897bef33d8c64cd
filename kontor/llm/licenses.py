"""License scans: template markup compiled to token automata.

A template is a license text in which ``[[ ... ]]`` marks wording that may be
left out and ``{{n}}`` marks a replaceable region of up to ``n`` words (a year,
a name).  Everything else is mandatory.  ``compile_template`` turns it into an
automaton over words; a place in a document is accepted when the automaton
reaches its end, so every mandatory word must stand there, in order.

Besides, three fixed phrases are found wherever their words stand
consecutively.  Words are maximal runs of ASCII letters and digits and of
non-ASCII characters, after A-Z became a-z.

Nulls and empty texts give no words, no places, no labels and score 0.  Equal
rows give equal results; long texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from kontor.llm.common import ASCII_WORD_BYTES, annotate

# The base phrases and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Wording of public licenses and notices, with markup.  ``-notice`` and
# ``-opening`` mark a reference to a license and its first words; the other labels want the
# whole wording, conditions and warranty included.
TEMPLATES = {
    "agpl-notice": "[[this {{3}} is]] licensed under the gnu affero general public license"
                   " [[version 3]] [[or any later version]]",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not"
                         " use this file except in compliance with the license you may obtain a"
                         " copy of the license at {{12}} unless required by applicable law or"
                         " agreed to in writing software distributed under the license is"
                         " distributed on an as is basis without warranties or conditions of any"
                         " kind either express or implied see the license for the specific"
                         " language governing permissions and limitations under the license",
    "apache-2.0-notice": "[[released|licensed]] under the apache license [[version]] 2 0",
    "bsd-notice": "[[released|licensed]] under the [[2 clause|3 clause|new|simplified]] bsd"
                  " license",
    "bsd": "redistribution and use in source and binary forms with or without modification are"
           " permitted provided that the following conditions are met [[1]] redistributions of"
           " source code must retain the above copyright notice this list of conditions and the"
           " following disclaimer [[2]] redistributions in binary form must reproduce the above"
           " copyright notice this list of conditions and the following disclaimer in the"
           " documentation and or other materials provided with the distribution [[[[3]] neither"
           " the name of {{12}} nor the names of its contributors may be used to endorse or promote"
           " products derived from this software without specific prior written permission]] this"
           " software is provided by {{12}} as is and any express or implied warranties including"
           " but not limited to the implied warranties of merchantability and fitness for a"
           " particular purpose are disclaimed in no event shall {{12}} be liable for any direct"
           " indirect incidental special exemplary or consequential damages including but not"
           " limited to procurement of substitute goods or services loss of use data or profits or"
           " business interruption however caused and on any theory of liability whether in"
           " contract strict liability or tort including negligence or otherwise arising in any"
           " way out of the use of this software even if advised of the possibility of such damage",
    "bsd-opening": "redistribution and use in source and binary forms with or without"
                   " modification are permitted provided that the following conditions are met",
    "cc-by-nc-notice": "licensed under [[a]] [[the]] cc by nc [[1 0|2 0|2 5|3 0|4 0]]",
    "cc-by-notice": "licensed under [[a]] [[the]] cc by [[1 0|2 0|2 5|3 0|4 0]]",
    "cc0-notice": "[[to the extent possible under law]] {{8}} has waived all copyright and related"
                  " or neighboring rights to {{12}} under cc0",
    "gpl-3.0-notice": "licensed under the gnu general public license version 3"
                      " [[or any later version]]",
    "gpl-program-notice": "this program is free software you can redistribute it and or modify it"
                          " under the terms of the gnu general public license as published by the"
                          " free software foundation [[either]] version {{3}} of the license [[or"
                          " at your option any later version]]",
    "isc": "permission to use copy modify and [[or]] distribute this software for any purpose with"
           " or without fee is hereby granted provided that the above copyright notice and this"
           " permission notice appear in all copies the software is provided as is and {{8}}"
           " disclaims all warranties with regard to this software including all implied"
           " warranties of merchantability and fitness in no event shall {{8}} be liable for any"
           " special direct indirect or consequential damages or any damages whatsoever resulting"
           " from loss of use data or profits whether in an action of contract negligence or other"
           " tortious action arising out of or in connection with the use or performance of this"
           " software",
    "isc-opening": "permission to use copy modify and [[or]] distribute this software for any"
                   " purpose with or without fee is hereby granted",
    "lgpl-notice": "licensed under the gnu lesser general public license [[version {{2}}]]",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this"
           " software and associated documentation files the software to deal in the software"
           " without restriction including without limitation the rights to use copy modify merge"
           " publish distribute sublicense and or sell copies of the software and to permit"
           " persons to whom the software is furnished to do so subject to the following"
           " conditions the above copyright notice and this permission notice [[including the next"
           " paragraph]] shall be included in all copies or substantial portions of the software"
           " the software is provided as is without warranty of any kind express or implied"
           " including but not limited to the warranties of merchantability fitness for a"
           " particular purpose and noninfringement in no event shall {{12}} be liable for any"
           " claim damages or other liability whether in an action of contract tort or otherwise"
           " arising from out of or in connection with the software or the use or other dealings"
           " in the software",
    "mit-opening": "permission is hereby granted free of charge to any person obtaining a copy of"
                   " this software and associated documentation files the software to deal in the"
                   " software without restriction",
    "mit-notice": "[[released|licensed]] under the mit license",
    "mpl-2.0-opening": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense-opening": "this is free and unencumbered software released into the public domain",
}

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in ASCII_WORD_BYTES else 32
               for b in range(256))


def normalise(text: bytes) -> bytes:
    """The text's words, each followed by one space, after a leading space."""
    words = text.translate(_TABLE).split()
    return b" " + b" ".join(words) + b" " if words else b""


def compile_template(markup: str) -> dict:
    """Markup to an automaton.

    States are numbered; ``words[s]`` maps a word to the states after it,
    ``any_word[s]`` is the state after any word in a replaceable region, and
    ``free[s]`` are states reached without a word.  ``anchor`` is the longest
    run of words that every accepted place must contain, and ``before`` the
    largest number of words that can stand between the start and the anchor.
    """
    pieces = re.findall(r"\[\[|\]\]|\||\{\{\d+\}\}|[^\s|\[\]{}]+", markup)
    words: list[dict] = [{}]
    any_word: list[set] = [set()]
    free: list[set] = [set()]
    depth: list[int] = [0]                   # most words on a way to the state

    def state(d: int) -> int:
        words.append({})
        any_word.append(set())
        free.append(set())
        depth.append(d)
        return len(words) - 1

    at, groups = 0, []                       # groups: (state before, ends of alternatives)
    run: list[str] = []
    run_depth, best, best_depth = 0, [], 0
    for p in pieces:
        if (p.startswith("{{") or p in ("[[", "]]", "|")) and not groups:
            if len(run) > len(best):
                best, best_depth = run, run_depth
            run = []
        if p == "[[":
            groups.append((at, []))
        elif p == "|":
            groups[-1][1].append(at)
            at = groups[-1][0]
        elif p == "]]":
            before, ends = groups.pop()
            ends.append(at)
            after = state(max(depth[e] for e in ends))
            for e in [before, *ends]:
                free[e].add(after)
            at = after
        elif p.startswith("{{"):
            ways, n = [at], int(p[2:-2])
            for _ in range(n):
                nxt = state(depth[at] + 1)
                any_word[at].add(nxt)
                at = nxt
                ways.append(at)
            after = state(depth[at])
            for w in ways:
                free[w].add(after)
            at = after
        else:
            if not groups:
                if not run:
                    run_depth = depth[at]
                run.append(p)
            nxt = state(depth[at] + 1)
            words[at].setdefault(p.encode(), set()).add(nxt)
            at = nxt
    if groups:
        raise ValueError(f"unclosed optional region in {markup!r}")
    if len(run) > len(best):
        best, best_depth = run, run_depth
    if not best:
        raise ValueError("a template needs mandatory wording")
    return {"words": words, "any": any_word, "free": free, "end": at,
            "anchor": b" " + " ".join(best).encode() + b" ", "before": best_depth}


def _closure(auto: dict, states: set) -> set:
    todo, seen = list(states), set(states)
    while todo:
        for s in auto["free"][todo.pop()]:
            if s not in seen:
                seen.add(s)
                todo.append(s)
    return seen


def accept(auto: dict, words: list[bytes], start: int) -> int | None:
    """End of the longest accepted place that starts at ``start``; None without one."""
    now, last = _closure(auto, {0}), None
    for i in range(start, len(words) + 1):
        if auto["end"] in now:
            last = i
        if i == len(words):
            break
        step = set()
        for s in now:
            step |= auto["words"][s].get(words[i], set()) | auto["any"][s]
        if not step:
            break
        now = _closure(auto, step)
    return last


def places(line: bytes, needle: bytes) -> Iterator[int]:
    """Number of the word at which each occurrence of ``needle`` starts, ascending."""
    at, spaces, counted = line.find(needle), 0, 0
    while at >= 0:
        spaces += line.count(b" ", counted, at + 1)       # on from the last occurrence
        counted = at + 1
        yield spaces - 1
        at = line.find(needle, at + 1)


def find_templates(line: bytes, words: list[bytes] | None,
                   automata: dict[str, dict]) -> list[tuple[str, int, int]]:
    """Accepted places (label, first word, end) in normalised text, longest per anchor."""
    found = []
    for label, auto in automata.items():
        for first in places(line, auto["anchor"]):
            words = line.split() if words is None else words
            spans = [(e - s, s, e) for s in range(max(0, first - auto["before"]), first + 1)
                     if (e := accept(auto, words, s)) is not None and e > first]
            if spans:
                _, s, e = max(spans, key=lambda x: (x[0], -x[1]))
                found.append((label, s, e))
    return found


def find_phrases(line: bytes) -> list[tuple[str, int, int]]:
    """Every place (label, first word, end) of a base phrase."""
    found = []
    for phrase, label in BASE_PHRASES.items():
        needle = f" {phrase} ".encode()
        found += [(label, first, first + needle.count(b" ") - 1)
                  for first in places(line, needle)]
    return found


FIELDS = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long",
          "base_labels": "string", "labels": "string", "score": "double",
          "n_templates": "long", "template_spans": "string"}


def make_scanner(templates: dict[str, str]):
    automata = {label: compile_template(t) for label, t in templates.items()}

    def scan(texts: list[bytes]) -> dict:
        out = {n: [] for n in FIELDS}
        for text in texts:
            line = normalise(text)
            n = line.count(b" ") - 1 if line else 0
            base, more = find_phrases(line), find_templates(line, None, automata)
            covered = set()
            for _, s, e in base + more:
                covered.update(range(s, e))
            starts = [s for _, s, _ in base]
            labels = {x for x, _, _ in base}
            out["n_words"].append(n)
            out["n_base"].append(len(base))
            out["first_word"].append(min(starts, default=None))
            out["last_word"].append(max(starts, default=None))
            out["base_labels"].append(",".join(sorted(labels)))
            out["labels"].append(",".join(sorted(labels | {x for x, _, _ in more})))
            out["score"].append(len(covered) / n if n else 0.0)
            out["n_templates"].append(len(more))
            out["template_spans"].append(",".join(
                f"{x}:{s}:{e}" for x, s, e in sorted(more, key=lambda y: (y[1], y[0]))))
        return out

    return scan


def scan_licenses(docs: DataFrame, text: str = "text",
                  templates: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with the license columns of ``FIELDS``.

    ``score`` is the share of the document's words that stand in an accepted
    place.  ``template_spans`` lists the automata's places as label:first:end
    (words from 0, end exclusive).
    """
    templates = dict(templates or TEMPLATES)
    return annotate(docs, text, lambda: make_scanner(templates), FIELDS)
