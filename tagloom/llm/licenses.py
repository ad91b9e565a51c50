"""License scans: fixed phrases, and templates compiled into automata over words.

A template is a text with markup: `[[ ... ]]` may be missing, `{{a b|c}}` is one of the
alternatives, `{{m,n}}` is any m to n words. All other wording is mandatory and must match word
by word.
"""

from __future__ import annotations

import itertools
import pkgutil
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from tagloom.llm.common import add_columns, fields, text_bytes

# Phrases and their labels, as the result is defined.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of public licenses and of usual notices.
_SOFTWARE = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software "
    "and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute "
    "sublicense and or sell copies of the software and to permit persons to whom the software is "
    "furnished to do so subject to the following conditions the above copyright notice and this "
    "permission notice [[including the next paragraph]] shall be included in all copies or "
    "substantial portions of the software the software is provided as is without warranty of any "
    "kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and {{noninfringement|non infringement}} in no event shall "
    "{{1,20}} be liable for any claim damages or other liability whether in an action of contract "
    "tort or otherwise arising from out of or in connection with the software or the use or other "
    "dealings in the software"
)
_REDISTRIBUTION = (
    "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met [[{{1|a}}]] redistributions of source code "
    "must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[{{2|b}}]] redistributions in binary form must reproduce the above copyright notice this "
    "list of conditions and the following disclaimer in the documentation and or other materials "
    "provided with the distribution"
)
_NO_ENDORSEMENT = (
    " [[{{3|c}}]] neither the name of {{1,20}} nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written "
    "permission"
)
_BSD_DISCLAIMER = (
    " this software is provided by {{1,20}} as is and any express or implied warranties including "
    "but not limited to the implied warranties of merchantability and fitness for a particular "
    "purpose are disclaimed in no event shall {{1,20}} be liable for any direct indirect "
    "incidental special exemplary or consequential damages including but not limited to "
    "procurement of substitute goods or services loss of use data or profits or business "
    "interruption however caused and on any theory of liability whether in contract strict "
    "liability or tort including negligence or otherwise arising in any way out of the use of "
    "this software even if advised of the possibility of such damage"
)


def _whole(name: str) -> str:
    """A template that is too long for this file."""
    return pkgutil.get_data("tagloom.llm", f"license_texts/{name}.txt").decode()


# Labels with -text are of whole licenses, to their ends; those of the same license without it,
# and mit-notice, are of lines that name it. The Creative Commons ones are such lines only.
TEMPLATES = {
    "apache-2.0": (
        "licensed under the apache license [[the license]] {{version 2 0|version 2}}",
        "{{released|distributed|available}} under the [[terms of the]] apache license "
        "{{version 2 0|2 0}}",
    ),
    "apache-2.0-text": (_whole("apache-2.0"),),
    "bsd-2-clause": (_REDISTRIBUTION + _BSD_DISCLAIMER,),
    "bsd-3-clause": (_REDISTRIBUTION + _NO_ENDORSEMENT + _BSD_DISCLAIMER,),
    "cc-by-4.0": (
        "cc by 4 0",
        "creative commons attribution 4 0 [[international]] [[public]] license",
    ),
    "cc-by-nc-4.0": (
        "cc by nc 4 0",
        "creative commons attribution noncommercial 4 0 [[international]] [[public]] license",
    ),
    "cc-by-sa-4.0": (
        "cc by sa 4 0",
        "creative commons attribution sharealike 4 0 [[international]] [[public]] license",
    ),
    "gpl-2.0": (
        "gnu general public license [[as published by the free software foundation]] "
        "[[either]] {{version 2|v 2|v2}} [[0]]",
    ),
    "gpl-2.0-text": (_whole("gpl-2.0"),),
    "gpl-3.0": (
        "gnu general public license [[as published by the free software foundation]] "
        "[[either]] {{version 3|v 3|v3}} [[0]]",
    ),
    "gpl-3.0-text": (_whole("gpl-3.0"),),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or "
        "without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies the software is provided as is and {{1,20}} "
        "{{disclaims|disclaim}} all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall {{1,20}} be liable for any "
        "special direct indirect or consequential damages or any damages whatsoever resulting "
        "from loss of use data or profits whether in an action of contract negligence or other "
        "tortious action arising out of or in connection with the use or performance of this "
        "software",
    ),
    "mit-notice": (
        "{{released|licensed|distributed|available}} under the [[terms of the]] mit license",
    ),
    "mit-text": (_SOFTWARE,),
}

# Bytes to the words they stand in: A-Z in lower case, a blank for all that parts words.
_PART = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]")
_FOLD = _PART.sub(b" ", bytes(range(256)).lower())


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased words: digits, a-z and all beyond ASCII."""
    return raw.translate(_FOLD).split()


@dataclass
class Automaton:
    """States with moves on a word, on any word, and without one. State 0 is the start."""

    on_word: list[dict[bytes, list[int]]] = field(default_factory=list)
    on_any: list[list[int]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    end: int = 0

    def state(self) -> int:
        self.on_word.append({})
        self.on_any.append([])
        self.free.append([])
        return len(self.free) - 1

    def closure(self, states: set[int]) -> set[int]:
        reached, open_ = set(states), list(states)
        while open_:
            for s in self.free[open_.pop()]:
                if s not in reached:
                    reached.add(s)
                    open_.append(s)
        return reached

    def match(self, words: list[bytes], start: int) -> int | None:
        """End of the longest match that starts at a word, None without one."""
        now, last, at = self.closure({0}), None, start
        while now:
            if self.end in now:
                last = at
            if at >= len(words):
                break
            word = words[at]
            moved = {t for s in now for t in (*self.on_word[s].get(word, ()), *self.on_any[s])}
            now, at = self.closure(moved), at + 1
        return last


_MARK = re.compile(r"\[\[|\]\]|\{\{.*?\}\}|[^\s\[\]{}]+")


def compile_template(text: str) -> tuple[list[bytes], Automaton]:
    """The wordings a match may start with, between blanks, and the automaton of a template."""
    machine = Automaton()
    at = machine.state()
    optional: list[int] = []

    def spell(state: int, words: list[str]) -> int:
        for w in words:
            after = machine.state()
            machine.on_word[state].setdefault(w.encode(), []).append(after)
            state = after
        return state

    def any_words(state: int, least: int, most: int) -> list[int]:
        ends = [state] if least == 0 else []
        for i in range(most):
            after = machine.state()
            machine.on_any[state].append(after)
            state = after
            if i + 1 >= least:
                ends.append(state)
        return ends

    tokens = _MARK.findall(text.lower())
    for token in tokens:
        if token == "[[":
            optional.append(at)
        elif token == "]]":
            machine.free[optional.pop()].append(at)
        elif token.startswith("{{"):
            body = token[2:-2]
            bounds = re.fullmatch(r"(\d+),(\d+)", body)
            if bounds:
                ends = any_words(at, int(bounds[1]), int(bounds[2]))
            else:
                ends = [spell(at, choice.split()) for choice in body.split("|")]
            at = machine.state()
            for e in ends:
                machine.free[e].append(at)
        else:
            at = spell(at, [token])
    machine.end = at
    fixed = list(itertools.takewhile(lambda t: t[0] not in "[{", tokens))
    if fixed:
        opening = [fixed]
    elif tokens and "|" in tokens[0]:
        opening = [choice.split() for choice in tokens[0][2:-2].split("|")]
    else:
        opening = []
    if optional or not all(opening) or not opening:
        raise ValueError("a template starts with mandatory wording and closes what it opens")
    return [b" " + " ".join(o).encode() + b" " for o in opening], machine


def _places(canon: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase between blanks starts."""
    found, at, counted, number = [], canon.find(phrase), 0, 0
    while at >= 0:
        number += canon.count(b" ", counted, at)
        counted = at
        found.append(number)
        at = canon.find(phrase, at + 1)
    return found


def scan_licenses(
    df: DataFrame,
    text: str = "text",
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    with_spans: bool = True,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and, if wished,
    spans (label, first word, word after the last) of every accepted template.

    score is 1 where a template is accepted, 0.5 where only phrases occur, else 0. Pure map: no
    shuffle. Null and empty texts have no words, null first_word and last_word, empty labels and
    score 0. Places may overlap; ties do not occur, repeated rows give equal results, an empty
    table stays empty, input columns of the names added are replaced. Very long texts are read
    once per phrase and template start.
    """
    outputs = fields(
        n_words="long", n_base="long", first_word="long", last_word="long",
        base_labels="string", labels="string", score="double",
    )
    if with_spans:
        span = StructType().add("label", StringType()).add("start", LongType()).add("stop", LongType())
        outputs.add("spans", ArrayType(span))

    def setup():
        wanted = {b" " + " ".join(p.lower().split()).encode() + b" ": n for p, n in phrases.items()}
        compiled = [
            (label, *compile_template(t)) for label, texts in templates.items() for t in texts
        ]

        def scan(raw: bytes) -> list:
            words = words_of(raw)
            canon = b" " + b" ".join(words) + b" "
            starts, base = [], set()
            for phrase, label in wanted.items():
                if found := _places(canon, phrase):
                    base.add(label)
                    starts += found
            spans = []
            for label, opening, machine in compiled:
                for o in opening:
                    for start in _places(canon, o):
                        stop = machine.match(words, start)
                        if stop is not None:
                            spans.append((label, start, stop))
            both = base | {s[0] for s in spans}
            score = 1.0 if spans else 0.5 if base else 0.0
            row = [len(words), len(starts), min(starts, default=None), max(starts, default=None)]
            row += [",".join(sorted(base)), ",".join(sorted(both)), score]
            if with_spans:
                row.append([dict(zip(("label", "start", "stop"), s)) for s in sorted(spans)])
            return row

        def work(texts):
            columns: list[list] = [[] for _ in outputs]
            for t in text_bytes(texts):
                for column, value in zip(columns, scan(t.as_py()), strict=True):
                    column.append(value)
            return columns

        return work

    return add_columns(df.withColumn(text, F.col(text).cast("string")), [text], outputs, setup, keep)
