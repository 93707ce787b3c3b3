"""License scans with template markup, compiled into token automata.

A template is wording with marked regions: `[[optional wording]]` may be missing, `{{n}}` stands for up to n words of any
kind, and `{{a|b|c}}` for one of the given wordings. It compiles into an automaton over words; a text holds the license
where the automaton reaches its end, so that all mandatory wording has to stand there exactly. Each template also has its
rarest mandatory phrase as anchor, which is looked up first; the automaton runs at the places where the template can begin.

Besides, the base phrases are counted wherever their words stand consecutively. Words are lower-cased runs of letters,
digits and non-ASCII characters, so that punctuation and line breaks do not matter. Null and empty texts have no words and
no labels. Rows are scanned each for itself: repeated rows, null ids and extra columns do not matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.arrowtext import LETTER_WORDS, texts

# Fixed values of the contract: phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices by which files and works state their license; the labels follow the short names in common use.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0 [[the license]]",
    "mit": "{{released|licensed|distributed|available}} under the [[terms of the]] {{mit|expat}} license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of {{this software|this work}} "
    "[[and associated documentation files]] {{8}} to deal in the {{software|work}} without restriction",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl": "{{is licensed|licensed|is distributed|distributed|released}} under the [[terms of the]] gnu general public license [[as published by the free software foundation]] "
    "[[version {{1}}]] [[or any later version]]",
    "gpl-3.0": "under the [[terms of the]] gnu general public license [[as published by the free software foundation]] {{version|v}} 3 [[0]] [[or later]]",
    "gpl-2.0": "under the [[terms of the]] gnu general public license [[as published by the free software foundation]] {{version|v}} 2 [[0]] [[or later]]",
    "cc-by-4.0": "licensed under [[a]] {{cc by|creative commons attribution}} 4 0 [[international]]",
    "cc-by-nc-4.0": "licensed under [[a]] {{cc by nc|creative commons attribution noncommercial}} 4 0 [[international]]",
    "cc-by-sa-4.0": "licensed under [[a]] {{cc by sa|creative commons attribution sharealike}} 4 0 [[international]]",
}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LETTER_WORDS).split()


class Automaton:
    """States 0..n-1 and `accept`; `word` moves by one given word, `free` by no word, `any` by any word."""

    def __init__(self, template: str):
        self.word: list[dict[bytes, list[int]]] = []
        self.free: list[list[int]] = []
        self.any: list[list[int]] = []
        self.mandatory: list[list[bytes]] = [[]]
        start = self._state()
        self.accept = self._region(template, start, True)
        self.start = self._closure({start})
        self.anchor = max(self.mandatory, key=lambda p: sum(map(len, p)))
        self.reach = self._reach(template)

    def _state(self) -> int:
        self.word.append({})
        self.free.append([])
        self.any.append([])
        return len(self.word) - 1

    def _words(self, text: str, at: int, mandatory: bool) -> int:
        for w in words_of(text.encode()):
            new = self._state()
            self.word[at].setdefault(w, []).append(new)
            at = new
            if mandatory:
                self.mandatory[-1].append(w)
        return at

    def _region(self, template: str, at: int, mandatory: bool) -> int:
        for piece in re.split(r"(\[\[.*?\]\]|\{\{.*?\}\})(?!\])", template):
            if piece.startswith("[["):
                end = self._region(piece[2:-2], at, False)
                self.free[at].append(end)
            elif piece.startswith("{{"):
                inner = piece[2:-2]
                end = self._state()
                if inner.isdigit():
                    self.free[at].append(end)
                    for _ in range(int(inner)):
                        new = self._state()
                        self.any[at].append(new)
                        self.free[new].append(end)
                        at = new
                else:
                    for choice in inner.split("|"):
                        self.free[self._words(choice, at, False)].append(end)
            else:
                at = self._words(piece, at, mandatory)
                continue
            at = end
            if self.mandatory[-1]:
                self.mandatory.append([])
        return at

    def _reach(self, template: str) -> int:
        """How many words may stand in front of the anchor: all words and fillers of the template bound it."""
        fillers = sum(int(n) for n in re.findall(r"\{\{(\d+)\}\}", template))
        return len(words_of(re.sub(r"\{\{\d+\}\}", " ", template).encode())) + fillers

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def longest(self, words: list[bytes], at: int) -> int:
        """The end of the longest match that starts at a word, or -1."""
        states, best, i = set(self.start), -1, at
        while states:
            if self.accept in states:
                best = i
            if i >= len(words):
                break
            states = self._closure({n for s in states for n in (*self.word[s].get(words[i], ()), *self.any[s])})
            i += 1
        return best


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Byte places of a phrase in words that are joined by blanks, with a blank at both ends."""
    out, at = [], joined.find(phrase)
    while at >= 0:
        out.append(at)
        at = joined.find(phrase, at + 1)
    return out


def scan_text(text: bytes, base: dict[bytes, str], automata: dict[str, Automaton]) -> tuple:
    """n_words, base hits [(word, label)], template hits [(label, start, end)], whether a template is the whole text."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    hits = [(at, label) for phrase, label in base.items() for at in places(joined, phrase)]
    marks = {name: found for name, a in automata.items() if (found := places(joined, b" " + b" ".join(a.anchor) + b" "))}
    if not hits and not marks:
        return len(words), [], []
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    word_at = lambda at: bisect_left(blanks, at)  # the blank before a word has the word's number
    found = []
    for name, at_bytes in marks.items():
        a, done = automata[name], -1
        for anchor in map(word_at, at_bytes):
            for start in range(max(0, anchor - a.reach, done), anchor + 1):
                end = a.longest(words, start)
                if end > anchor:
                    found.append((name, start, end))
                    done = end
                    break
    return len(words), sorted((word_at(at), label) for at, label in hits), sorted(found, key=lambda x: x[1:])


SCHEMA = (
    "doc_id long, n_words long, base array<struct<word:long,label:string>>, licenses array<struct<label:string,start:long,end:long>>"
)


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """Per row: `doc_id`, `n_words`, `base` (places of base phrases), `licenses` (word spans that a template accepts)."""
    templates, phrases = templates or TEMPLATES, base or BASE
    types = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()),
        ("base", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
        ("licenses", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = {name: Automaton(t) for name, t in templates.items()}
        wanted = {b" " + b" ".join(words_of(p.encode())) + b" ": label for p, label in phrases.items()}
        for batch in batches:
            rows = [scan_text(t, wanted, automata) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([r[0] for r in rows], pa.int64()),
                pa.array([[{"word": w, "label": x} for w, x in r[1]] for r in rows], types.field(2).type),
                pa.array([[{"label": x, "start": s, "end": e} for x, s, e in r[2]] for r in rows], types.field(3).type),
            ], schema=types)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, SCHEMA)


def license_labels(scanned: DataFrame) -> DataFrame:
    """Distinct sorted labels and a score: 1 where a template accepts, 0.5 for base phrases alone, 0 for nothing."""
    own = F.transform("base", lambda b: b["label"])
    more = F.transform("licenses", lambda b: b["label"])
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["word"])).alias("first_word"), F.array_max(F.transform("base", lambda b: b["word"])).alias("last_word"),
        join(own).alias("base_labels"), join(F.concat(own, more)).alias("labels"),
        F.when(F.size("licenses") > 0, 1.0).when(F.size("base") > 0, 0.5).otherwise(0.0).alias("score"), "licenses",
    )
