"""License notices in texts, also misspelt ones: exact seeds by pigeonhole, then bounded-error matching."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import add_columns, whole_text

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Short notices by label. What is between stars must stand as it is; the rest may hold errors.
NOTICES = [
    ("mit", "under the* mit *license"),
    ("mit", "*mit *license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "apache license version* 2*"),
    ("apache-2", "apache license* v2*"),
    ("apache-2", "apache license* 2*"),
    ("cc-by-nc", "*cc by nc*"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nc-sa", "*cc by nc sa*"),
    ("cc-by-nc-nd", "*cc by nc nd*"),
    ("cc-by-sa", "*cc by sa*"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-nd", "*cc by nd*"),
    ("cc-by", "*cc by *4 0"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("cc0", "*cc0 *1 0 universal"),
    ("gpl-2", "gnu general public license version* 2*"),
    ("gpl-2", "gnu general public license* v2*"),
    ("gpl-3", "gnu general public license version* 3*"),
    ("gpl-3", "gnu general public license* v3*"),
    ("gpl-2", "*gplv2*"),
    ("gpl-2", "*gpl v2*"),
    ("gpl-3", "*gplv3*"),
    ("gpl-3", "*gpl v3*"),
    ("lgpl-2", "gnu lesser general public license version* 2*"),
    ("lgpl-3", "gnu lesser general public license version* 3*"),
    ("agpl-3", "gnu affero general public license version* 3*"),
    ("mpl-2", "mozilla public license version* 2*"),
    ("epl-2", "eclipse public license version* 2*"),
    ("boost-1", "boost software license version* 1*"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "under the* bsd *license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
]

CHARS_AN_ERROR = 10  # a notice may hold one error for so many of its characters
PART_BYTES = 1 << 21
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # of a text whose A-Z stand as they are
_SPACED = bytes(
    c if c >= 0x80 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)


@dataclass(frozen=True)
class Notice:
    """A notice's words joined by spaces, and which of its characters are free to differ."""

    label: str
    text: str
    parts: tuple[tuple[str, bool], ...]  # text, fixed
    errors: int

    @classmethod
    def read(cls, label: str, marked: str, chars_an_error: int) -> Notice:
        parts = tuple((part, i % 2 == 1) for i, part in enumerate(marked.split("*")) if part)
        free = sum(len(part) for part, fixed in parts if not fixed)
        return cls(label, marked.replace("*", ""), parts, free // chars_an_error)

    def pattern(self) -> str:
        body = "".join(
            re.escape(part) if fixed or not self.errors else f"(?:{re.escape(part)}){{e<={self.errors}}}"
            for part, fixed in self.parts
        )
        return rf"(?b)(?<= ){body}(?= )"

    def seeds(self) -> list[tuple[str, int]]:
        """errors + 1 pieces and where they start: so many errors leave one of them as it is."""
        cuts = np.linspace(0, len(self.text), self.errors + 2).astype(int).tolist()
        return [(self.text[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


class Search:
    """All notices and base phrases over one automaton."""

    def __init__(self, notices: tuple[tuple[str, str], ...], base: tuple[tuple[str, str], ...], chars_an_error: int) -> None:
        import ahocorasick
        import regex

        self.notices = [Notice.read(*n, chars_an_error) for n in notices]
        self.verify = [regex.compile(n.pattern()) for n in self.notices]
        self.base = base
        found: dict[str, tuple[list, list]] = {}
        for i, notice in enumerate(self.notices):
            for seed, at in notice.seeds():
                found.setdefault(seed, ([], []))[0].append((i, at))
        for i, (phrase, _) in enumerate(base):
            found.setdefault(f" {phrase} ", ([], []))[1].append(i)
        self.automaton = ahocorasick.Automaton()
        for key, (seeds, phrases) in found.items():
            self.automaton.add_word(key, (len(key), seeds, phrases))
        self.automaton.make_automaton()

    def _spans(self, text: str, candidates: dict[int, set[int]]) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, errors, score) in the spaced text: of spans of a label that overlap, the best."""
        found = []
        for i, starts in candidates.items():
            notice, k = self.notices[i], self.notices[i].errors
            for start in starts:
                low = max(start - k - 1, 0)
                hit = self.verify[i].search(text[low : start + len(notice.text) + k + 1])
                if hit and sum(hit.fuzzy_counts) <= k:
                    errors = sum(hit.fuzzy_counts)
                    found.append((notice.label, low + hit.start(), low + hit.end(), errors, 1 - errors / (k + 1)))
        best: list[tuple[str, int, int, int, float]] = []
        for span in sorted(set(found), key=lambda x: (x[0], x[1], x[3], -x[2])):
            if best and best[-1][0] == span[0] and span[1] < best[-1][2]:
                if (span[3], best[-1][1] - best[-1][2]) < (best[-1][3], span[1] - span[2]):
                    best[-1] = span
            else:
                best.append(span)
        return best

    def find(self, text: str) -> dict:
        words = text.encode("utf-8", "surrogatepass").translate(_SPACED).split()
        spaced = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
        candidates: dict[int, set[int]] = {}
        places: list[tuple[int, str]] = []
        for end, (length, seeds, phrases) in self.automaton.iter(spaced):
            start = end - length + 1
            for i, at in seeds:
                candidates.setdefault(i, set()).add(start - at)
            places += [(start + 1, self.base[i][1]) for i in phrases]
        spans = self._spans(spaced, candidates) if candidates else []
        out = {"n_words": len(words), "places": [], "base": [], "labels": [], "score": 0.0, "spans": []}
        if places or spans:
            own = [m.span() for m in _WORD.finditer(text)]
            begins = np.cumsum([0] + [b - a + 1 for a, b in own]) + 1
            word = lambda at: int(np.searchsorted(begins, at, "right")) - 1
            out["places"] = [word(at) for at, _ in places]
            out["base"] = sorted({label for _, label in places})
            out["labels"] = sorted({*out["base"], *(s[0] for s in spans)})
            out["score"] = 1.0 if places else max(s[4] for s in spans)
            out["spans"] = [
                {"label": label, "start": own[word(a)][0], "end": own[word(b - 1)][1], "errors": errors}
                for label, a, b, errors, _ in sorted(spans, key=lambda s: (s[1], s[0]))
            ]
        return out


@lru_cache(maxsize=4)
def _search(*args) -> Search:
    return Search(*args)


OUTPUTS = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, "
    "labels array<string>, score double, spans array<struct<label: string, start: bigint, end: bigint, errors: bigint>>"
)
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int64())]))


def scan(
    docs: DataFrame,
    notices: list[tuple[str, str]] = NOTICES,
    base: dict[str, str] = BASE,
    chars_an_error: int = CHARS_AN_ERROR,
) -> DataFrame:
    """All columns of docs, and n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are the ASCII-lower-cased runs of [0-9a-z] and characters beyond ASCII. Base places are those
    where a `base` phrase's words stand one after the other; n_base counts them, first_word and last_word
    are the least and largest word (from 0) at which one begins, null without any. A notice is found
    where whole words equal it but for a character added, lost or changed per `chars_an_error` of its
    free characters. `labels` are those of base places and of notices; `spans` are the notices' places
    (label, start, end in code points, end exclusive, errors), of overlapping spans of a label the one
    with fewest errors. `score` is 1 with a base place or a notice without error, falls to 1 / (k + 1)
    for one with all its k errors, and is 0 without any.

    Nothing is shuffled; a task holds a part of a batch and its longest text. Null and empty texts have no words.
    Repeated rows get the same result each; an empty table gives an empty one; columns named like the
    results are replaced.
    """
    asked = (tuple(notices), tuple(base.items()), chars_an_error)

    def run(part: pa.RecordBatch) -> list[pa.Array]:
        search = _search(*asked)
        found = [search.find(text) for text in part.column("text").to_pylist()]
        return [
            pa.array([f["n_words"] for f in found], pa.int64()),
            pa.array([len(f["places"]) for f in found], pa.int64()),
            pa.array([min(f["places"], default=None) for f in found], pa.int64()),
            pa.array([max(f["places"], default=None) for f in found], pa.int64()),
            pa.array([f["base"] for f in found], pa.list_(pa.string())),
            pa.array([f["labels"] for f in found], pa.list_(pa.string())),
            pa.array([f["score"] for f in found], pa.float64()),
            pa.array([f["spans"] for f in found], _SPAN),
        ]

    return add_columns(docs, {"text": whole_text()}, OUTPUTS, run, "text", PART_BYTES)
