"""Licence scan: exact phrases, and short notices with a bounded number of edits.

A notice with at most k edits, cut into k + 1 pieces, keeps one piece unchanged
(pigeonhole). An Aho-Corasick automaton finds all pieces in one scan; from each word start
that fits a hit, the regex library's bounded-error matching verifies the edits up to the end
of a word, so no place within the errors is missed.
"""

from __future__ import annotations

import bisect

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import slices

# Phrases and labels of the base scan.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Short notices as words in lower case; one label may have several.
NOTICES = [
    ("all rights reserved", "reserved"),
    ("general public license", "gpl"),
    ("lesser general public license", "lgpl"),
    ("affero general public license", "agpl"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("gnu free documentation license", "gfdl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution", "cc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("released into the public domain", "public-domain"),
    ("no rights reserved", "cc0"),
    ("boost software license", "bsl"),
]

_LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def normal_words(text: str | None) -> bytes:
    """Words in lower case (ASCII only), one space around each: ' a b '; b' ' if none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return b" " + b" ".join(words) + b" " if words else b" "


def places(stream: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase's words stand one after the other."""
    out, at, number, counted = [], stream.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        number, counted = number + stream.count(b" ", counted, at), at
        out.append(number)
        at = stream.find(b" " + phrase + b" ", at + 1)
    return out


class FuzzyNotices:
    """Matches notices with at most ``error_share`` of their characters edited."""

    def __init__(self, notices: list[tuple[str, str]], error_share: float = 0.1, least_piece: int = 6):
        self.automaton = ahocorasick.Automaton()
        self.notices = []
        seeds: dict[str, list[tuple[int, int, int]]] = {}
        for k, (phrase, label) in enumerate(notices):
            errors = min(int(len(phrase) * error_share), max(0, len(phrase) // least_piece - 1))
            # At most so many edits, and as few as can be, over a whole stretch of words.
            pattern = regex.compile(f"(?b)(?:{regex.escape(phrase)}){{e<={errors}}}")
            self.notices.append((phrase, label, errors, pattern))
            cuts = [len(phrase) * i // (errors + 1) for i in range(errors + 2)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(phrase[i:j], []).append((k, i, j))
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, tuple(uses))
        if seeds:
            self.automaton.make_automaton()

    def starts(self, stream: str) -> dict[int, set[int]]:
        """Word starts from which each notice can match: a seed's place fixes them to its errors."""
        found: dict[int, set[int]] = {}
        if not self.notices:
            return found
        for end, uses in self.automaton.iter(stream):
            for k, i, j in uses:
                at, errors = end + 1 - j, self.notices[k][2]
                held = found.setdefault(k, set())
                for s in range(max(0, at - errors), min(len(stream), at + errors + 1)):
                    if stream[s] != " " and (s == 0 or stream[s - 1] == " "):
                        held.add(s)
        return found

    def closest(self, k: int, stream: str, start: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best match of notice k from a word start to a word end.

        Ends are as far away as the notice is long, give or take its errors. The regex library
        matches each stretch whole: fixed at both edges, its fewest edits are the edit distance.
        """
        phrase, _, errors, pattern = self.notices[k]
        best = None
        end = stream.find(" ", max(start + 1, start + len(phrase) - errors))
        while end >= 0 and end <= start + len(phrase) + errors:
            if stream[end - 1] != " " and (hit := pattern.fullmatch(stream, start, end)) is not None:
                found = (sum(hit.fuzzy_counts), start, end)
                best = found if best is None else min(best, found)
            end = stream.find(" ", end + 1)
        return best

    def matches(self, stream: str) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, edits, similarity) in characters of the stream.

        A match starts and ends between words and has as many edits as its notice allows. Of
        overlapping places of one notice that with the fewest edits stands.
        """
        out = []
        for k, held in self.starts(stream).items():
            phrase, label = self.notices[k][:2]
            hits = [hit for start in held if (hit := self.closest(k, stream, start))]
            taken: list[tuple[int, int]] = []  # disjoint and sorted
            for edits, start, end in sorted(hits):
                at = bisect.bisect_left(taken, (start, end))
                if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                    taken.insert(at, (start, end))
                    out.append((label, start, end, edits, 1 - edits / len(phrase)))
        out = sorted(set(out), key=lambda m: (m[1], m[2], m[0], m[3]))
        # Of notices that differ in a word or two, the closest one stands for a place. Matches
        # are at most as long as the longest one, so only near starts can overlap.
        starts, widest = [m[1] for m in out], max((m[2] - m[1] for m in out), default=0)

        def closer(m):
            near = out[bisect.bisect_right(starts, m[1] - widest) : bisect.bisect_left(starts, m[2])]
            return any(o[4] > m[4] and m[1] < o[2] and o[2] - o[1] >= m[2] - m[1] - 2 for o in near)

        return [m for m in out if not closer(m)]


FOUND = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "matches array<struct<label:string,first_word:int,n_words:int,edits:int,similarity:double,span:string>>"
)
_MATCH = pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("edits", pa.int32()), ("similarity", pa.float64()), ("span", pa.string())])
_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(_MATCH)),
    ]
)


def scan_text(text: str | None, base: dict[bytes, str], fuzzy: FuzzyNotices) -> tuple:
    stream = normal_words(text)
    n_words = stream.count(b" ") - 1 if len(stream) > 1 else 0
    starts, base_labels = [], set()
    for phrase, label in base.items():
        if found := places(stream, phrase):
            starts.extend(found)
            base_labels.add(label)
    plain = stream.decode("utf-8", "replace")
    found, number, counted = [], 0, 0
    for label, start, end, edits, alike in fuzzy.matches(plain):  # in order of their starts
        number, counted = number + plain.count(" ", counted, start), start
        found.append((label, number - 1, plain.count(" ", start, end) + 1, edits, alike, plain[start:end]))
    labels = base_labels | {f[0] for f in found}
    score = max([1.0 if starts else 0.0, *(f[4] for f in found)])
    return n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, found


def scan_licenses(
    docs: DataFrame,
    base: dict[str, str] | None = None,
    notices: list[tuple[str, str]] | None = None,
    error_share: float = 0.1,
) -> DataFrame:
    """Licence labels, places and scores of every document, in one narrow pass.

    ``matches`` lists fuzzy spans by words; ``score`` is 1 with an exact phrase, else the
    best similarity (1 - edits / length), 0 without any. Null and empty texts have no words,
    empty label lists and null places. Whole texts of any length are scanned; a null
    ``doc_id`` stays; repeated rows give repeated results; other columns are ignored.
    """
    phrases = {k.encode(): v for k, v in (BASE_PHRASES if base is None else base).items()}
    fixed = NOTICES if notices is None else notices

    def run(batches):
        fuzzy = FuzzyNotices(fixed, error_share)
        keys = [f.name for f in _MATCH]
        for batch in slices(batches):
            rows = [scan_text(t, phrases, fuzzy) for t in batch.column(1).to_pylist()]
            columns = [list(c) for c in zip(*rows, strict=True)]
            columns[-1] = [[dict(zip(keys, m, strict=True)) for m in ms] for ms in columns[-1]]
            arrays = [batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_SCHEMA)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)
