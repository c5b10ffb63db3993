"""Typed values mapped to the one name of a reference list that they stand for.

All names and aliases are the patterns of one automaton; it reads the value's
words and finds every pattern embedded in it, of which the longest without overlap
count. Values in which nothing is found are compared with the patterns as sets of
words, by letters in common over letters in all, in whatever order. Words meet
through an index of their segments, so that misspelt ones do too, as do words
written together or apart. What is near no pattern is reported as unmatched.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.storage import cut, tasks_for_cpu

UNMATCHED = "UNMATCHED"
#: Names and aliases that one automaton takes; longer lists are refused.
MAX_PATTERNS = 200_000
#: Least overlap of two sets of words: of any two, and where all words of the pattern are met.
LEAST_OVERLAP, LEAST_OVERLAP_WHOLE = 0.6, 0.4
#: Most words of a value that are read as one.
_JOINED = 4

_UNSEEN = re.compile("[­͏؜​-‏‪-‮⁠-⁯︀-️﻿̀-ͯ]+")
_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-Z])")
_RUN = re.compile(r"[^\W_]+")
# Letters of other alphabets that look like Latin ones.
_ALIKE = str.maketrans("аеорсухіјѕԁһԛԝвкмнтαοερνικτυχАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwbkmhtaoepvikтyxABEKMHOPCTYXIJSABEZHIKMNOPTYX")
def words(value: str) -> list[str]:
    """Words of a value, without case, accents, look-alike letters and invisible characters."""
    v = unicodedata.normalize("NFKD", value)
    v = _CAMEL.sub(" ", _UNSEEN.sub("", v).translate(_ALIKE))
    return _RUN.findall(v.casefold())


def edits(a: str, b: str, most: int) -> int:
    """Edit distance in which swapped letters count once, also around a lost or added one; most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    top = len(a) + len(b)
    table = [[top] * (len(b) + 2), [top, *range(len(b) + 1)]]
    seen_at: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        row, last_match = [top, i], 0
        for j, y in enumerate(b, 1):
            i0, j0 = seen_at.get(y, 0), last_match
            swap = table[i0][j0] + (i - i0 - 1) + 1 + (j - j0 - 1)
            if x == y:
                last_match = j
            row.append(min(table[i][j] + (x != y), row[j] + 1, table[i][j + 1] + 1, swap))
        seen_at[x] = i
        table.append(row)
    return min(table[-1][-1], most + 1)


def allowed_edits(length: int) -> int:
    return 0 if length < 3 else 1 if length < 7 else 2 if length < 16 else 3


def _parts(length: int, pieces: int) -> list[tuple[int, int]]:
    """Bounds of a word's segments, as even as they go."""
    ends = [length * i // pieces for i in range(pieces + 1)]
    return list(zip(ends, ends[1:]))


class Segments:
    """Words that lie within the edits allowed of a given one, by segments.

    An edit touches at most two letters, so of 2k + 1 segments one stays whole under
    k edits, moved by at most k places.
    """

    def __init__(self, known: Iterable[str]) -> None:
        self.index: dict[tuple[int, int, str], list[str]] = defaultdict(list)
        for w in known:
            pieces = 2 * allowed_edits(len(w)) + 1
            for i, (a, b) in enumerate(_parts(len(w), pieces)):
                self.index[len(w), i, w[a:b]].append(w)
        self.lengths = {n for n, _, _ in self.index}
        self._near = functools.lru_cache(maxsize=100_000)(self._search)

    def near(self, word: str) -> dict[str, int]:
        """Known words within the edits allowed for both, with their distances."""
        return self._near(word)

    def _search(self, word: str) -> dict[str, int]:
        found, limit = {}, allowed_edits(len(word))
        for size in range(len(word) - limit, len(word) + limit + 1):
            if size not in self.lengths:
                continue
            most = min(limit, allowed_edits(size))
            candidates: set[str] = set()
            for i, (a, b) in enumerate(_parts(size, 2 * allowed_edits(size) + 1)):
                for shift in range(-most, most + 1):
                    if 0 <= a + shift and b + shift <= len(word):
                        candidates.update(self.index.get((size, i, word[a + shift : b + shift]), ()))
            for w in candidates:
                if (d := edits(word, w, most)) <= most:
                    found[w] = d
        return found


class Canonical:
    """A reference list, ready to look values up."""

    def __init__(self, entries: list[tuple[str, str]]) -> None:
        """``entries``: (spelling, name it stands for). Of equal spellings a name's own comes first, then the smallest name."""
        self.patterns: dict[str, str] = {}
        for spelling, name in sorted(entries, key=lambda e: (e[0] != e[1], e[1], e[0])):
            w = words(spelling)
            if w:
                self.patterns.setdefault(" ".join(w), name)
        self.words_of = {p: p.split() for p in self.patterns}
        # Inverted index: each run of a pattern's words, written as one word, and the places it comes from.
        self.places: dict[str, list[tuple[str, int, int]]] = defaultdict(list)
        for p, ws in self.words_of.items():
            for i in range(len(ws)):
                for j in range(i + 1, len(ws) + 1):
                    self.places["".join(ws[i:j])].append((p, i, j))
        self.segments = Segments(self.places)
        self.automaton = ahocorasick.Automaton()
        for p in self.patterns:
            self.automaton.add_word(f" {p} ", p)
        if self.patterns:
            self.automaton.make_automaton()

    def embedded(self, tokens: list[str]) -> list[str]:
        """Names of the longest patterns without overlap, in their order."""
        if not self.patterns:
            return []
        line = f" {' '.join(tokens)} "
        hits = sorted(((end - len(p) - 1, end, p) for end, p in self.automaton.iter(line)), key=lambda h: (-len(h[2]), h[0]))
        taken: list[tuple[int, int, str]] = []
        for a, b, p in hits:
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, p))
        return [self.patterns[p] for _, _, p in sorted(taken)]

    def similar(self, tokens: list[str]) -> str | None:
        """The name whose pattern's words overlap most with the value's; None if too little or two names tie.

        The overlap is the letters of the words that meet, less their share of edits, over the letters
        of all words of both. Each word is met once, the nearest first.
        """
        meetings: dict[str, list[tuple]] = defaultdict(list)
        for i in range(len(tokens)):
            for j in range(i + 1, min(len(tokens), i + _JOINED) + 1):
                joined = "".join(tokens[i:j])
                for unit, d in self.segments.near(joined).items():
                    for p, x, y in self.places[unit]:
                        meetings[p].append((d / max(len(joined), len(unit)), -len(unit), i, j, x, y))
        best: dict[str, float] = {}
        for p, found in meetings.items():
            # The nearest first, or the longest first: words written together may be nearer apart and the other way round.
            overlap, whole = max(self._overlap(tokens, self.words_of[p], sorted(found)), self._overlap(tokens, self.words_of[p], sorted(found, key=lambda m: (m[1], *m))))
            if overlap > (LEAST_OVERLAP_WHOLE if whole else LEAST_OVERLAP):
                name = self.patterns[p]
                best[name] = max(best.get(name, 0.0), overlap)
        most = max(best.values(), default=0.0)
        names = [n for n, o in best.items() if most - o < 1e-9]
        return names[0] if len(names) == 1 else None

    @staticmethod
    def _overlap(tokens: list[str], pattern: list[str], meetings: list[tuple]) -> tuple[float, bool]:
        """Overlap when words meet in the order given, and whether all words of the pattern meet one."""
        ours: set[int] = set()
        theirs: set[int] = set()
        weight = 0.0
        for share, size, i, j, x, y in meetings:
            if ours.isdisjoint(range(i, j)) and theirs.isdisjoint(range(x, y)):
                ours.update(range(i, j))
                theirs.update(range(x, y))
                weight -= size * (1 - share)
        extra = sum(len(t) for i, t in enumerate(tokens) if i not in ours)
        return weight / (sum(map(len, pattern)) + extra), len(theirs) == len(pattern)

    def find(self, value: str) -> str:
        """The name a value stands for, or UNMATCHED."""
        tokens = words(value)
        if not tokens:
            return UNMATCHED
        names = self.embedded(tokens) or self.embedded([t[:-1] if t.endswith("s") and len(t) > 3 else t for t in tokens])
        if names:
            return names[0]
        return self.similar(tokens) or UNMATCHED


def _mapper(entries: list[tuple[str, str]], own: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Canonical(entries)
        for b in batches:
            names = [v if v in own else index.find(v) for v in b.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("value"), pa.array(names, pa.string())], names=["value", "canonical_name"])

    return run


def map_to_list(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """``(row_id, value, canonical_name)`` for each ``rows(row_id, value)`` with a value.

    ``reference(name, aliases)``. canonical_name is the name that the value is or
    means, through an alias, an embedded mention or a misspelling, else UNMATCHED.
    Of several embedded names the first of the longest counts. A value that is
    equally near to two names is unmatched. Null and blank values give no row, repeated rows are
    mapped each. Null names and null or blank aliases are ignored; an empty list
    leaves all unmatched. Extra columns are ignored. Each different value is looked up once and
    joined back; the list is sent to every task and must have at most MAX_PATTERNS spellings.
    """
    spellings = reference.where(F.col("name").isNotNull()).select(
        F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("spelling"), "name"
    )
    entries = [tuple(r) for r in spellings.where(F.trim("spelling") != "").distinct().limit(MAX_PATTERNS + 1).collect()]
    if len(entries) > MAX_PATTERNS:
        raise ValueError(f"the reference list has more than {MAX_PATTERNS} spellings; split it and map against each part")
    own = frozenset(n for _, n in entries)
    values = rows.where(F.col("value").isNotNull() & F.col("value").rlike(r"(?U)\S")).select("row_id", "value")
    # Written, so that the join knows how many different values there are.
    different = cut(values.select("value").distinct())
    names = cut(different.repartition(tasks_for_cpu(rows.sparkSession), "value").mapInArrow(_mapper(entries, own), "value string, canonical_name string"))
    return values.join(names, "value").select("row_id", "value", "canonical_name")
