"""Sentences of texts in many languages and scripts.

Blank lines and list lines bound units by layout; inside them, a scan over
terminators, quotes and brackets decides. What is ambiguous, a full stop after
something that may be an abbreviation, is settled from unambiguous occurrences in
the same document (does the next word occur there in small letters, or
capitalised inside a sentence?), then from counts over the whole corpus, which
show what stands before a full stop without ending a sentence. Scripts without
capitals or spaces have rules of their own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.batches import slices
from kgspark.storage import at_most, spread

_NL = r"(?:\r\n|[\n\r\v\f\x1c-\x1e\x85 ])"
_BLANK = re.compile(rf"{_NL}(?:(?!{_NL})\s)*{_NL}\s*| \s*")
_LINE = re.compile(_NL)
_LIST = re.compile(r"\s*(?:[-*+•‣▪◦·●]|\(?\d{1,2}\)|\(?[a-z]\))\s+\S")
_NUMBERED = re.compile(r"\s*\d{1,3}\.\s+\S")
_HEADING = re.compile(r"\s*(?:chapter|section|part|kapitel|abschnitt|teil|chapitre|partie|capítulo|parte|глава|часть|раздел)\s+\d+\.", re.I)
_EVENT = re.compile(r"[.!?…。！？؟।॥]+|[(\[（「『“„«\"]")
_THAI = re.compile(r"[฀-๏]")
_THAI_EVENT = re.compile(_EVENT.pattern + r"|(?<=[฀-๏)\]”»\"])[^\S\r\n\v\f\x1c-\x1e\x85  ]+(?=[฀-๏(\[“«\"])")
_CLOSERS = re.compile(r"[\"'”’»)\]）」』]*")
_TOKEN = re.compile(r"[^\s(\[«„“\"—–¿¡/]*$")
_AHEAD = re.compile(r"[\s(\[«„“\"‘'—–¿¡「『（-]*")
_WORD = re.compile(r"[^\W\d_]+")
_PAIRS = {"(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "“": "”", "„": "“”", "«": "»", '"': '"'}
_BRACKETS = frozenset("([（")
_TERMINATORS = frozenset(".!?…。！？؟।॥")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ]")
_SAID_ZH = re.compile(r"[^。！？“”\s]{0,15}?(?:问|说|道|喊|叫|答)")
_INITIALS = re.compile(r"(?:[^\W\d_]\.)*[^\W\d_]$")

# Written before a name or a number, or in the middle of a sentence, so never its end.
NEVER_FINAL = frozenset(
    """mr mrs ms dr drs prof st ste capt lt col gen maj sgt rev hon gov sen rep pres messrs mt ft fig figs eq vol vols ch pp no nos approx cf viz vs ed eds
    i.e e.g d.h z.b u.a o.ä p.ex p.ej т.е т.к т.н hr fr hrn dipl ing nr bzw ca vgl bd abb tel str mme mlle mm mgr sr sra srta dra dres ud uds d dña núm pág cap av avda
    env art им ул см стр рис ок напр тов гр акад доц проф д-ра д-р др.пр свв св""".split()
)
# Written before numbers.
BEFORE_NUMBERS = frozenset("no nos nr núm n nº approx ca env ок circa vol vols ch p pp pág fig figs eq art cap bd abb s стр рис гл т см cf vgl § b d d.h i.e e.g z.b".split())
# Single small letters with a full stop that often end a sentence.
_FINAL_LETTERS = frozenset("гдпвсл")
# What makes a number with a full stop a German ordinal.
_ORDINAL = frozenset(
    """januar jänner februar märz april mai juni juli august september oktober november dezember
    jahrhundert jahrhunderts jh jahrtausend jahrestag tag woche monat auflage klasse kapitel stock band""".split()
)
# Arabic words that carry a sentence on after a quoted question.
_ARABIC_ON = frozenset("ثم لكن ولكن حتى قبل بعد".split())

#: A token before a full stop counts as an abbreviation from this many sightings and this share of them inside sentences.
MIN_SIGHTINGS, MIN_INSIDE = 5, 0.6
#: A token stands before numbers from this share of all its sightings.
MIN_NUMBERS = 0.8
#: Abbreviations that are broadcast; more are refused.
MAX_ABBREVIATIONS = 200_000
_SIGHTING = re.compile(r"(?<![^\s(\[«„“\"])([^\W\d_]{1,6})\.(?=([,;:])|\s+([^\W_]))")
_RUN = re.compile(r"\w+")
_AFTER_WORD = re.compile(r"[^\W\d_,](?=\s+(\w+))")
INSIDE, OUTSIDE, NUMBER = range(3)


def sightings(text: str) -> Iterator[tuple[str, int]]:
    """Short tokens with a full stop, and what follows: the rest of the sentence, a capital, or a number."""
    for m in _SIGHTING.finditer(text):
        after = m.group(3)
        if m.group(2) or after.islower():
            yield m.group(1).lower(), INSIDE
        elif after.isupper():
            yield m.group(1).lower(), OUTSIDE
        elif after.isdigit():
            yield m.group(1).lower(), NUMBER


class Abbreviations(NamedTuple):
    """What the corpus shows: tokens that go on, and tokens that stand before numbers."""

    inside: frozenset[str] = frozenset()
    numbers: frozenset[str] = frozenset()


class _Document:
    """What one document shows about its own words."""

    def __init__(self, text: str, abbreviations: Abbreviations) -> None:
        self.text, self.abbreviations = text, abbreviations
        self._inside: set[str] | None = None
        self._words: set[str] | None = None
        self._after_words: set[str] = set()

    def abbreviation(self, token: str) -> bool:
        if token in self.abbreviations.inside:
            return True
        if self._inside is None:
            self._inside = {t for t, kind in sightings(self.text) if kind == INSIDE}
        return token in self._inside

    def name(self, word: str) -> bool:
        """Capitalised inside a sentence, and nowhere in small letters."""
        if self._words is None:  # read once, however many stops there are
            self._words = set(_RUN.findall(self.text))
            self._after_words = set(_AFTER_WORD.findall(self.text))
        return word.lower() not in self._words and word in self._after_words


def _closing(text: str, at: int, end: int) -> int:
    """Place of the mark that closes the one at ``at``, or -1."""
    opener = text[at]
    closers = _PAIRS[opener]
    if len(closers) > 1:
        places = [p for c in closers if (p := text.find(c, at + 1, end)) >= 0]
        return min(places, default=-1)
    place = text.find(closers, at + 1, end)
    if opener == closers or place < 0:
        return place
    depth, i = 1 + text.count(opener, at + 1, place), place
    while depth > 1:
        following = text.find(closers, i + 1, end)
        if following < 0:
            return i
        depth += text.count(opener, i + 1, following) - 1
        i = following
    return i


def _full_stop(doc: _Document, start: int, at: int, after: int, ahead: int, end: int, cased: bool) -> bool:
    """Whether the full stop at ``at`` ends a sentence; ``ahead`` is where the next word begins."""
    text = doc.text
    c = text[ahead]
    if c in ",;:)]»”":
        return False
    if cased and c.islower():
        return False
    token = _TOKEN.search(text[max(start, at - 24) : at]).group()
    low = token.lower()
    if not token:
        return True
    if _THAI.match(token[-1]):
        return False
    if "ऀ" <= token[-1] <= "ॿ":
        return len(token) > 4
    if token.isdigit():
        if not c.isalpha():
            return True
        word = _WORD.match(text, ahead, end)
        return not (len(token) <= 2 and word and word.group().lower() in _ORDINAL)
    if c.isdigit():
        return not (low in BEFORE_NUMBERS or (len(token) == 1 and token.isalpha() and low not in _FINAL_LETTERS) or low in doc.abbreviations.numbers)
    if len(token) == 1 and token.isalpha():
        return low in _FINAL_LETTERS and token.islower() or not c.isalpha() and text[ahead - 1] in "“«\"„¿¡"
    if low in NEVER_FINAL:
        return False
    if "." in token and token.isupper() and _INITIALS.match(token):
        return False
    if len(token) <= 6 and c.isupper() and doc.abbreviation(low):
        word = _WORD.match(text, ahead, end)
        return not (word and doc.name(word.group()))
    return True


def _glued(text: str, start: int, run: str, at: int, after: int, c: str, quote: int) -> bool:
    """Whether a terminator without space after it can end a sentence: the space was lost."""
    opens = c.isupper() or c.isdigit() and not text[after].isdigit() or c.isalpha() and not c.islower()
    if quote >= 0 or set(run) & set("!?؟"):
        return opens or c.isdigit()
    token = _TOKEN.search(text[max(start, at - 24) : at]).group()
    if len(run) > 1 or not token:
        return False
    if token[-1].isdigit():
        return opens and c.isalpha()
    word = len(token) > 2 and token.isalpha() and not token.isupper() or "." in token and token[-1].islower() and len(token) <= 4
    return word and (opens or c.isdigit() and len(token) > 2 and token.isalpha())


def _ends(doc: _Document, start: int, run: str, at: int, after: int, end: int, cased: bool, quote: int) -> bool:
    """Whether a unit that began at ``start`` ends at ``after``; quote: where the quotation just closed began, or -1."""
    text = doc.text
    if after >= end:
        return True
    spaced = text[after].isspace()
    before = text[at - 1] if at > start else " "
    wide = run[-1] in "。！？" or (run[-1] in "!?" and _CJK.match(before))
    ahead = _AHEAD.match(text, after, end).end()
    if ahead >= end:
        return True
    c = text[ahead]
    if quote >= 0 and (wide or _CJK.match(c) or _CJK.match(before)) and not spaced:
        if c in "、，,。！？：；" or text[quote] in "「『" and "぀" <= c <= "ゟ":
            return False
        begins = not text[start:quote].strip()
        return not (text[quote] in "“\"" and begins and _SAID_ZH.match(text, after, end))
    if run[-1] in "。।॥":
        return True
    if wide:
        return c not in "、，,"
    if not spaced and not _glued(text, start, run, at, after, c, quote):
        return False
    if set(run) <= {".", "…"} and (len(run) > 1 or run == "…"):
        return quote >= 0 or not (cased and c.islower() or c.isdigit() or c in ",;:")
    uncased = c.isalpha() and not c.isupper() and not c.islower()
    if quote >= 0:
        if c in ",;:":
            return False
        if uncased:
            if not text[start:quote].strip():
                return False
            word = text[ahead : ahead + 12].split()
            return not (run[-1] in "?!؟" and word and word[0] in _ARABIC_ON)
        return not (cased and c.islower())
    if run[-1] in "!?؟" or set(run) & set("!?؟"):
        return not (cased and c.islower() or c in ",;:")
    return _full_stop(doc, start, at, after, ahead, end, cased)


def _sentences(doc: _Document, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Sentences between two places of the text that hold no layout bounds."""
    text = doc.text
    piece = text[a:b]
    cased = piece.lower() != piece
    event = _THAI_EVENT if _THAI.search(piece) else _EVENT
    heading = _HEADING.match(text, a, b)
    start, pos = a, heading.end() if heading and not re.search(r"[.!?]\s", text[heading.end() : b]) else a
    while m := event.search(text, pos, b):
        first = m.group()[0]
        if first.isspace():
            yield start, m.start()
            start = pos = m.end()
            continue
        quote = -1
        if first in _PAIRS:
            close = _closing(text, m.start(), b)
            if close < 0:
                pos = m.end()
                continue
            pos = close + 1
            inner = text[m.start() + 1 : close].rstrip()
            if first in _BRACKETS and text[start : m.start()].strip() or not inner or inner[-1] not in _TERMINATORS:
                continue
            quote, at, run = m.start(), m.start() + len(inner), inner[-1]
            after = _CLOSERS.match(text, pos, b).end() if not text[pos : pos + 1].isspace() else pos
        else:
            at, run = m.start(), m.group()
            after = pos = m.end()
            if after < b and not text[after].isspace() and text[after] not in _PAIRS:
                after = _CLOSERS.match(text, after, b).end()
        if _ends(doc, start, run, at, after, b, cased, quote):
            yield start, after
            start = pos = after
        else:
            pos = max(pos, after)
    yield start, b


def _layout(text: str) -> Iterator[tuple[int, int, bool]]:
    """Parts between blank lines and list lines; True for a list line."""
    at = 0
    for m in (*_BLANK.finditer(text), None):
        a, b, at = at, m.start() if m else len(text), m.end() if m else 0
        breaks = list(_LINE.finditer(text, a, b))
        if not breaks:
            yield a, b, bool(_LIST.match(text, a, b))
            continue
        lines = list(zip((a, *(x.end() for x in breaks)), (*(x.start() for x in breaks), b)))
        lines = [(x, y) for x, y in lines if text[x:y].strip()]
        numbered = len(lines) > 1 and all(_NUMBERED.match(text, x, y) or _LIST.match(text, x, y) for x, y in lines)
        prose = None
        listed = False
        for x, y in lines:
            mark = numbered or _LIST.match(text, x, y)
            if mark or listed:
                if prose is not None:
                    yield prose, before, False
                    prose = None
                listed = True
                yield x, y, True
            elif prose is None:
                prose = x
            before = y
        if prose is not None:
            yield prose, before, False


def units(text: str, abbreviations: Abbreviations = Abbreviations()) -> list[tuple[int, int]]:
    """Units of a text as code-point ranges without white space around them."""
    doc = _Document(text, abbreviations)
    found = []
    for a, b, whole in _layout(text):
        for x, y in ((a, b),) if whole else _sentences(doc, a, b):
            part = text[x:y]
            left = len(part) - len(part.lstrip())
            if left < len(part):
                found.append((x + left, x + len(part.rstrip())))
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        tokens, kinds = zip(*seen) if seen else ((), ())
        out = pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(kinds, pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["token", "kind", "n"])
        seen.clear()
        return out

    for b in batches:
        for text in b.column("text").to_pylist():
            seen.update(sightings(text))
        if len(seen) > 200_000:
            yield flush()
    yield flush()


def corpus_abbreviations(documents: DataFrame) -> DataFrame:
    """``(token, inside, outside, numbers)``: what follows short tokens with a full stop, over all documents.

    Only tokens are listed that mostly stand inside sentences or before numbers.
    """
    counts = spread(documents.where(F.length("text") > 0).select("text")).mapInArrow(_count, "token string, kind int, n bigint")
    counts = counts.groupBy("token").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(("inside", "outside", "numbers"))])
    seen = F.col("inside") + F.col("outside")
    return counts.where(
        (seen >= MIN_SIGHTINGS) & (F.col("inside") >= MIN_INSIDE * seen)
        | (F.col("numbers") >= MIN_SIGHTINGS) & (F.col("numbers") >= MIN_NUMBERS * (seen + F.col("numbers")))
    )


def learn(documents: DataFrame) -> Abbreviations:
    """The corpus fallback of ``units``; tokens have at most 6 letters, more than MAX_ABBREVIATIONS are refused."""
    found = at_most(corpus_abbreviations(documents), MAX_ABBREVIATIONS, "abbreviations")
    return Abbreviations(
        frozenset(r["token"] for r in found if r["inside"] >= MIN_SIGHTINGS and r["inside"] >= MIN_INSIDE * (r["inside"] + r["outside"])),
        frozenset(r["token"] for r in found if r["numbers"] >= MIN_NUMBERS * (r["inside"] + r["outside"] + r["numbers"])),
    )


def _splitter(abbreviations: Abbreviations):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                row, start, end = [], [], []
                for i, text in enumerate(b.column("text").to_pylist()):
                    for x, y in units(text, abbreviations):
                        row.append(i)
                        start.append(x)
                        end.append(y)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                    names=["doc_id", "unit_start", "unit_end"],
                )

    return run


def sentences(documents: DataFrame) -> DataFrame:
    """``(doc_id, unit_start, unit_end)`` for each unit of each ``documents(doc_id, text)`` row.

    Offsets are code points, from 0, end exclusive, without white space around the
    unit; together the units cover everything else. A unit is a sentence with its
    closing marks, a heading, or a line of a list. Null, empty and blank texts give
    no row; a text without any terminator is one unit for each paragraph. Rows
    repeated in the input are repeated in the result. Extra columns are ignored.
    Two passes over the texts, no shuffle of them.
    """
    abbreviations = learn(documents)
    texts = spread(documents.where(F.length("text") > 0).select("doc_id", "text"))
    return texts.mapInArrow(_splitter(abbreviations), "doc_id bigint, unit_start bigint, unit_end bigint")
