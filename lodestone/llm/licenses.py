"""Licence scans: template markup compiled into token automata.

A template is a licence's wording in which [ ... ] is an optional region and
<a-b> a replaceable region of a to b words.  It is compiled into an automaton on
words; a text is accepted where the automaton runs from a word to its end, that
is, where all mandatory wording stands exactly, with any choice of the regions.

Words: after lower-casing A-Z, runs of a-z, 0-9 and characters outside ASCII.

Beside the templates, fixed phrases are counted (the base): n_base places in
all, first_word and last_word their smallest and largest word index, base_labels
their labels.  labels has the templates' too.  score: 1 if a template accepts,
else 0.5 if a phrase stands in the text, else 0.25 if the opening of a template (its
first six mandatory words) stands, as in a licence whose later wording was altered,
else 0.

Edge cases: a null or empty text has no words, empty label strings, score 0 and
null first_word and last_word; repeated rows are judged each; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textops as T

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_BSD_START = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_ONE = "[1|a] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_TWO = "[2|b] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_THREE = "[3|c] neither the name of <1-12> nor the names of [its|the] contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = (
    "this software is provided by <1-12> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall <1-12> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)

_GPL_NOTICE = "free software you can redistribute it and or modify it under the terms of the {0} general public license as published by the free software foundation either version <1-2> of the license or [at your option] any later version <2-4> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {0} general public license for more details"

#: The wording of well-known licences, from their first mandatory word to their last, and of short notices.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of <1-3> software and associated documentation files [the software] to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <1-8> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd-2-clause", f"{_BSD_START} {_BSD_ONE} {_BSD_TWO} {_BSD_END}"),
    ("bsd-3-clause", f"{_BSD_START} {_BSD_ONE} {_BSD_TWO} {_BSD_THREE} {_BSD_END}"),
    ("isc", "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <1-8> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <1-8> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("apache-notice", "licensed under the apache license version 2 0 [the license] you may not use this file except in compliance with the license you may obtain a copy of the license at [http|https] www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    *((f"{kind}gpl-notice", _GPL_NOTICE.format(name)) for kind, name in (("", "gnu"), ("l", "gnu lesser"), ("a", "gnu affero"))),
    ("mit", "[released|licensed|distributed] under the [terms of the] mit license"),
    ("apache", "[released|licensed|distributed] under the [terms of the] apache license version 2 0"),
    ("bsd", "[released|licensed|distributed] under the [terms of the] [2 clause|3 clause|new|simplified] bsd license"),
    ("gpl", "licensed under the [terms of the] gnu general public license [as published by the free software foundation] [version <1-2>]"),
    ("cc-by-nc", "licensed under [a|the] [creative commons] cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial <1-4> license"),
)


#: mandatory words of a template's opening
OPENING = 6


def word_hash(word: str) -> int:
    t = T.tokenize(pa.array([word]), T.ALNUM, True)
    if len(t.starts) != 1:
        raise ValueError(f"not one word: {word!r}")
    return int(t.hashes()[0])


@dataclass
class Automaton:
    """States 0..n; steps: by state and word hash the next states; free: states that any word leads on from; jumps: epsilon moves."""

    label: str
    steps: list[dict[int, set[int]]]
    free: list[set[int]]
    jumps: list[set[int]]
    accept: int
    depth: list[int]  # mandatory words before a state
    total: int

    def closure(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in self.jumps[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def firsts(self) -> set[int]:
        return {h for s in self.closure({0}) for h in self.steps[s]}

    def run(self, hashes: list[int], at: int, end: int) -> tuple[bool, int]:
        """(accepted from word at, most mandatory words matched)."""
        states, deepest = self.closure({0}), 0
        while states:
            deepest = max(deepest, *(self.depth[s] for s in states))
            if self.accept in states:
                return True, self.total
            if at >= end:
                break
            h = hashes[at]
            moved = {t for s in states for t in self.steps[s].get(h, ())} | {t for s in states for t in self.free[s]}
            states, at = self.closure(moved), at + 1
        return False, deepest


def compile_template(label: str, markup: str) -> Automaton:
    steps: list[dict[int, set[int]]] = [{}]
    free: list[set[int]] = [set()]
    jumps: list[set[int]] = [set()]
    depth = [0]

    def state(d: int) -> int:
        steps.append({})
        free.append(set())
        jumps.append(set())
        depth.append(d)
        return len(depth) - 1

    at, mandatory, opened, branch_ends, inside = 0, 0, 0, [], False
    for token in re.findall(r"\[|\]|\||<\d+-\d+>|\w+", markup):
        if token == "[":
            if inside:
                raise ValueError(f"nested optional region in {markup!r}")
            inside, opened, branch_ends = True, at, []
        elif token == "|":
            branch_ends.append(at)
            at = opened
        elif token == "]":
            new = state(mandatory)
            for s in [*branch_ends, at, opened]:
                jumps[s].add(new)
            at, inside = new, False
        elif token[0] == "<":
            low, high = map(int, token[1:-1].split("-"))
            leave = []
            for k in range(high + 1):
                if k >= low:
                    leave.append(at)
                if k < high:
                    new = state(mandatory)
                    free[at].add(new)
                    at = new
            new = state(mandatory)
            for s in leave:
                jumps[s].add(new)
            at = new
        else:
            mandatory += not inside
            new = state(mandatory)
            steps[at].setdefault(word_hash(token), set()).add(new)
            at = new
    if inside:
        raise ValueError(f"open optional region in {markup!r}")
    automaton = Automaton(label, steps, free, jumps, at, depth, mandatory)
    if any(free[s] for s in automaton.closure({0})):
        raise ValueError(f"a template may not begin with a replaceable region: {markup!r}")
    return automaton


def template_pattern(markup: str, opening: int | None = None) -> str:
    """A template as a regular expression over words that each have a space behind; opening: up to that mandatory word."""
    out, n, inside = "", 0, False
    for token in re.findall(r"\[|\]|\||<\d+-\d+>|\w+", markup):
        if token in "[]|":
            inside = token != "]"
            out += {"[": "(?:", "|": "|", "]": ")?"}[token]
        elif token[0] == "<":
            low, high = token[1:-1].split("-")
            out += f"(?:[^ ]+ ){{{low},{high}}}"
        else:
            out += token + " "
            n += not inside
            if n == opening and not inside:
                break
    return out


def scan_column(column: pa.Array, automata: list[Automaton], phrases: list[tuple[list[int], str]]) -> dict[str, list]:
    t = T.tokenize(column, T.ALNUM, True)
    h, rows = t.hashes(), t.rows
    n_base, first, last = np.zeros(rows, np.int64), np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
    base: list[set[str]] = [set() for _ in range(rows)]
    for words, label in phrases:
        at = t.windows(len(words))
        for k, word in enumerate(words):
            at = at[h[at + k] == np.uint64(word)]
        row, place = t.row[at], at - t.first[t.row[at]]
        n_base += np.bincount(row, minlength=rows)
        np.minimum.at(first, row, place)
        np.maximum.at(last, row, place)
        for r in np.unique(row).tolist():
            base[r].add(label)
    found = [set(x) for x in base]
    score = np.where(n_base > 0, 0.5, 0.0)
    firsts = {f for a in automata for f in a.firsts()}
    starts = np.flatnonzero(np.isin(h, np.array(sorted(firsts), dtype=np.uint64)))
    by_first: dict[int, list[Automaton]] = {}
    for a in automata:
        for f in a.firsts():
            by_first.setdefault(f, []).append(a)
    hashes = h.tolist() if len(starts) else []
    for i in starts.tolist():
        r = int(t.row[i])
        end = int(t.first[r + 1])
        for a in by_first[hashes[i]]:
            ok, deepest = a.run(hashes, i, end)
            if ok:
                found[r].add(a.label)
                score[r] = 1.0
            elif deepest >= OPENING:
                score[r] = max(score[r], 0.25)
    join = lambda x: ",".join(sorted(x))
    return {
        "n_words": t.counts.tolist(), "n_base": n_base.tolist(),
        "first_word": [f if n else None for f, n in zip(first.tolist(), n_base.tolist(), strict=True)],
        "last_word": [f if n else None for f, n in zip(last.tolist(), n_base.tolist(), strict=True)],
        "base_labels": list(map(join, base)), "labels": list(map(join, found)), "score": score.tolist(),
    }


_KINDS = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}
_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document, in one pass without a shuffle."""
    automata = [compile_template(label, markup) for label, markup in templates]
    hashed = [([word_hash(w) for w in phrase.split()], label) for phrase, label in phrases]

    def run(batches):
        for batch in batches:
            for part in T.slices(batch):
                out = scan_column(part.column("text"), automata, hashed)
                yield pa.RecordBatch.from_arrays([part.column("k"), *(pa.array(out[n], _ARROW[k]) for n, k in _KINDS.items())], ["k", *_KINDS])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"k {kind}, " + ", ".join(f"{n} {k}" for n, k in _KINDS.items()))
    return found.withColumnRenamed("k", key)
