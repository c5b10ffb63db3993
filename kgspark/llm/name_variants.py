"""Spellings of names that stand for one person or organisation.

A name is read into a core (family name, or an organisation's own word), a class
(given name; kind and number of the organisation) and its writing. Cores of a class
are put into tries, by length, and every core walks the tries of its class with a
Levenshtein automaton, held as bit sets. Given names and kinds are found in any
order of words, so that turned and comma forms meet. Names with only an initial, a
nickname of several names, or no given name are linked where just one bearer fits.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Collection, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.canonical import edits
from kgspark.operators.components import connected_components
from kgspark.storage import at_most, cut, tasks_for_cpu

#: Strings in one trie; larger shards are split into several, each walked by all that fit the shard.
TRIE_STRINGS = 20_000
#: A first word stands before so many times more different words than those stand behind, if it is a given name.
GIVEN_NAMES_RATIO = 3
#: Learned words that are sent to the tasks, some tens of bytes each; more are refused.
MAX_GIVEN, MAX_KINDS = 500_000, 200_000

# Given names by which short forms are understood.
_SHORT = """
alexander: alex sasha sandy alec | alexandra: sasha alex sandra lexi | agnes: aggie | anthony: tony | benjamin: ben benny benji | catherine: cathy kate kitty
charles: charlie chuck chas | christopher: chris kit topher | cyril: cy | daniel: dan danny | david: dave | dorothea: dora dolly thea dory | edward: ed eddie ned ted teddy
ekaterina: katya katia kate | elizabeth: betty liz lizzie beth eliza lisa | francisco: paco pancho frank cisco | george: georgie | guadalupe: lupe lupita
henrietta: etta hettie hetty | henry: harry hank | ignacio: nacho iggy | james: jim jimmy | johannes: hannes hans jo | john: jack johnny | joseph: joe
josephine: josie jo fifi | katharina: kathi kit katya käthe | leonard: len lenny leo | lidia: lida | margaret: peggy meg maggie | maria: mary mia | michael: mike mick | mikhail: misha
nikolai: kolya nick niko | oskar: ossi | patricia: pat patty trish tricia | peter: pete | pilar: pili | quentin: quin | richard: dick rick richie | robert: bob rob bobby bert
rosa: rosie rosita | samuel: sam sammy | simon: si | stephen: steve | susan: sue | tamar: tammy | theodor: ted teddy theo | thomas: tom | ulrich: uli ulli | ursula: uschi ulla | vera: verochka
vladimir: volodya vova | william: bill will billy liam | xenia: ksenia | zachary: zack zach zac
"""
SHORT_FORMS: dict[str, set[str]] = {}
GIVEN: set[str] = set()
for _entry in _SHORT.replace("\n", "|").split("|"):
    if ":" in _entry:
        _full, _, _forms = _entry.partition(":")
        GIVEN.add(_full.strip())
        for _form in _forms.split():
            SHORT_FORMS.setdefault(_form, set()).add(_full.strip())
# Words before and after names, and forms of companies.
TITLES = frozenset("mr mrs ms miss mme mlle dr prof professor capt captain herr frau senor senora senorita don dona sr sra sir dame lady lord rev col gen st late the somebody".split())
DEGREES = frozenset("msc phd md ba ma bsc mba esq dds llm llb".split())
FORMS = frozenset("ltd inc gmbh co llc plc ag sa sarl bv corp kg oy limited incorporated".split())
_SMALL = frozenset("of the and de la du der von & for".split())

# Cyrillic letters as the Latin letters they are written for, and look-alikes of Latin letters.
_CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщыэьъюя", "a b v g d e e zh z i i k l m n o p r s t u f h ts ch sh sh i e".split() + ["", ""] + "iu ia".split()))
_ALIKE = str.maketrans("аеорсухіјѕкмнтвυοραε", "aeopcyxijskmhtbuopae")
_ONLY_CYRILLIC = frozenset("бвгджзилпуфцчшщыэюяйё")
_DIGIT_INSIDE = re.compile(r"(?<=[^\W\d_])[013458](?=[^\W\d_])")
_DIGITS = dict(zip("013458", "oleasb"))
# Cyrillic letters that are written for several Latin ones.
_SPOKEN = {"и": "iy", "к": "ckqx", "в": "vw", "й": "jy", "с": "sc", "г": "g", "х": "h", "ч": "c", "ж": "z", "ш": "s"}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_NUMBER = re.compile(r"(?:\bn[or°]\.?|\bно\.?|№|#|\bnumber)\s*(\d+)|\b(\d+)\b", re.I)
_QUOTED = re.compile(r"[\"“”«»„]([^\"“”«»„]*)[\"“”«»„]|\([^()]*\)")
_BLOCK = re.compile(r"(?:[^\W\d_]\.\s?){1,4}$|[^\W\d_]$")
_DOTTED = re.compile(r"\b((?:[^\W\d_]\.){2,})")


def _bare(text: str) -> str:
    """Text without accents and invisible characters; digits inside words as the letters they look like."""
    if text.isascii():
        return _DIGIT_INSIDE.sub(lambda m: _DIGITS[m.group()], text)
    t = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return _DIGIT_INSIDE.sub(lambda m: _DIGITS[m.group()], t)


@functools.lru_cache(maxsize=200_000)
def fold(word: str) -> str:
    """A word as it sounds across alphabets: without case, accents, look-alikes, and with c = ch = q = k, y = j = i, x = ks, w = v."""
    w = _bare(word).casefold()
    cyrillic = sum("Ѐ" <= c <= "ӿ" for c in w)
    if cyrillic:
        if cyrillic * 2 <= len(w) and not any(c in _ONLY_CYRILLIC for c in w):
            w = w.translate(_ALIKE)
        w = "".join(_CYRILLIC.get(c, c) for c in w)
    for x, y in (("ch", "k"), ("c", "k"), ("q", "k"), ("x", "ks"), ("y", "i"), ("j", "i"), ("w", "v")):
        w = w.replace(x, y)
    return w


def initials_of(letter: str, latin: bool) -> str:
    """Latin letters an initial may stand for; in a Latin name a Cyrillic letter is a look-alike."""
    c = _bare(letter).casefold()[:1]
    if latin:
        c = c.translate(_ALIKE)
    return _SPOKEN.get(c) or (_CYRILLIC.get(c) or c)[:1]


class Kinds:
    """Kinds of organisations as tuples of words, short ones mapped to their full form; of things that are none, too."""

    def __init__(self) -> None:
        self.full: dict[tuple[str, ...], tuple[str, ...]] = {}
        self.things: set[tuple[str, ...]] = set()
        self.by_first: dict[int, dict[str, list[tuple[str, ...]]]] = {}
        self._begins: dict[tuple[int, str, bool], list[str]] = {}

    def add(self, phrase: tuple[str, ...], thing: bool) -> None:
        """Phrases come in order of their frequency, so a short form finds its full one."""
        fulls = dict.fromkeys(self.full[p] for p in self.candidates([(w, False) for w in phrase]))
        full = next((f for f in fulls if all(_shortens(w, g, False) for w, g in zip(phrase, f))), phrase)
        self.full[phrase] = full
        if thing and full == phrase:
            self.things.add(full)
        firsts = self.by_first.setdefault(len(phrase), {})
        if phrase[0] not in firsts:
            for (size, short, dotted), known in self._begins.items():
                if size == len(phrase) and _shortens(short, phrase[0], dotted):
                    known.append(phrase[0])
        firsts.setdefault(phrase[0], []).append(phrase)

    def candidates(self, words: list[tuple[str, bool]]) -> Iterator[tuple[str, ...]]:
        """Phrases of as many words whose first word the first one may be written for."""
        firsts, key = self.by_first.get(len(words), {}), (len(words), *words[0])
        begins = self._begins.get(key)
        if begins is None:
            if len(self._begins) > 100_000:
                self._begins.clear()
            begins = self._begins[key] = [f for f in firsts if _shortens(words[0][0], f, words[0][1])]
        for f in begins:
            yield from firsts[f]

    def find(self, words: list[tuple[str, bool]]) -> tuple[str, ...] | None:
        """The full kind that the words are, or are the only one to be short for."""
        exact = self.full.get(tuple(w for w, _ in words))
        if exact:
            return exact
        fits = {self.full[p] for p in self.candidates(words) if all(_shortens(w, f, dot) for (w, dot), f in zip(words, p))}
        return fits.pop() if len(fits) == 1 else None


class Lexicon:
    """Given names, their short forms and kinds of organisations, all folded.

    ``given`` maps to the first letter of the name as it is spelt.
    """

    def __init__(self, given: dict[str, str], short: dict[str, frozenset[str]], kinds: Kinds) -> None:
        self.given, self.short, self.kinds = given, short, kinds
        self.in_order = sorted(given)
        self.trie = Trie(self.in_order)
        self.near = functools.lru_cache(maxsize=100_000)(self._near)

    def beginning(self, word: str) -> frozenset[str]:
        """Given names that begin with a word."""
        at = bisect_left(self.in_order, word)
        end = at
        while end < len(self.in_order) and self.in_order[end].startswith(word):
            end += 1
        return frozenset(self.in_order[at:end])

    def _near(self, word: str) -> frozenset[str]:
        """Given names nearest to a misspelt one."""
        if len(word) < 4:
            return frozenset()
        near = {g: d for g, d in self.trie.within(word, 2) if d <= (1 if len(g) < 6 else 2)}
        least = min(near.values(), default=0)
        return frozenset(g for g, d in near.items() if d == least)


class Reading(NamedTuple):
    """Class and core of a name, and how sure its given name is: full, initial, some (several) or none."""

    grp: str
    core: str
    certainty: str


def _shortens(short: str, full: str, dotted: bool) -> bool:
    """Whether a word is written for another: the same, misspelt, or its letters in order from the first on."""
    if short == full:
        return True
    if dotted and len(short) <= 4 and fold(full[0]) in map(fold, short) and (len(short) == 1 or short in _SPOKEN.values()):
        return True
    if len(short) >= 4 and len(full) >= 5 and edits(short, full, 2) <= (1 if len(full) < 7 else 2):
        return True
    if not short or short[0] != full[0] or len(short) >= len(full):
        return False
    if not dotted and len(short) > 4:
        return False
    rest = iter(full)
    return all(c in rest for c in short)


def _organisation(tokens: list[tuple[str, bool]], number: str, lexicon: Lexicon) -> Reading | None:
    """The reading as an organisation: a known kind at the end or the beginning, the own words besides."""
    words = [(w, dot) for w, dot in tokens if w not in _FOLDED_SMALL]
    bare = [(w, dot) for w, dot in words if w not in _FOLDED_FORMS]
    words = [(w, dot) for w, dot in words if w not in _FOLDED_FORMS or w in _SHORTENING_FORMS]
    for these in (words, bare):
        for size in (3, 2, 1):
            if len(these) <= size:
                continue
            for own, kind in ((these[:-size], these[-size:]), (these[size:], these[:size])):
                if size == 1 and (len(kind[0][0]) < 3 or kind[0][0] in _SPOKEN.values() or len(own) > 2):
                    continue
                found = lexicon.kinds.find(kind)
                own = [w for w, _ in own if w not in _FOLDED_FORMS]
                if found and own and max(map(len, own)) > 3:
                    return Reading(f"O|{' '.join(found)}|{number}", "".join(own), "full")
    return None


def _given(word: str, dotted: bool, lexicon: Lexicon) -> frozenset[str]:
    """Given names a word may stand for."""
    if word in lexicon.given:
        return frozenset([word])
    if word in lexicon.short:
        return lexicon.short[word]
    if dotted and len(word) > 1:
        return lexicon.beginning(word)
    return frozenset()


def read_name(name: str, lexicon: Lexicon) -> list[Reading]:
    """Readings of a name; several if it is not known which word is which."""
    text = _bare(name)
    text = _QUOTED.sub(" ", text)
    number = next((a or b for a, b in _NUMBER.findall(text)), "")
    text = _NUMBER.sub(" ", text)
    text = _DOTTED.sub(lambda m: " " + m.group(1).replace(".", ". "), text)
    shouted = text.upper() == text
    latin = re.search(r"[A-Za-z]{3}", text) is not None
    raw = [(m.group(), m.end() < len(text) and text[m.end()] == ".", m.start()) for m in _WORD.finditer(text)]
    if not raw:
        return []
    owned = False
    tokens: list[tuple[str, bool]] = []
    places: list[int] = []
    for word, dot, at in raw:
        m = re.search(r"['’][sSсС]$", word)
        owned = owned or m is not None
        word = word[: m.start()] if m else word
        if len(word) in (2, 3) and word.isupper() and not shouted and not dot and fold(word) not in _FOLDED_FORMS and fold(word) not in _FOLDED_DEGREES and len(raw) < 4:
            for c in word:  # a block of initials
                tokens.append((initials_of(c, latin), True))
                places.append(-1)
        elif len(word) == 1:
            tokens.append((initials_of(word, latin), True))
            places.append(-1)
        else:
            tokens.append((fold(word), dot))
            places.append(at)
    letters = [w if p < 0 else "" for (w, _), p in zip(tokens, places)]
    begins = not number and len(tokens) == 2 and tokens[0][1] and places[0] >= 0 and _given(*tokens[0], lexicon)
    if not begins and (number or len(tokens) > 1):
        if sum(map(bool, letters)) > 2:  # as in I. o. T.
            keep = [i for i, w in enumerate(letters) if not (w == "o" and 0 < i < len(letters) - 1 and letters[i - 1] and letters[i + 1])]
            shortened = [tokens[i] for i in keep]
        else:
            shortened = tokens
        found = _organisation(shortened, number, lexicon)
        if found:
            return [found] if tuple(found.grp.split("|")[1].split()) not in lexicon.kinds.things else []
    return _person(tokens, places, text, owned, lexicon)


def _person(tokens: list[tuple[str, bool]], places: list[int], text: str, owned: bool, lexicon: Lexicon) -> list[Reading]:
    comma = text.find(",")
    kept = [(w, dot, p) for (w, dot), p in zip(tokens, places) if w not in _FOLDED_TITLES and w not in _FOLDED_DEGREES]
    long = [(w, dot, p) for w, dot, p in kept if p >= 0]
    initials = [w for w, _, p in kept if p < 0]
    if len(long) == 2 and not initials:  # "ye somebody": initials written small
        block = next((w for w, dot, _ in long if len(w) == 2 and not _given(w, dot, lexicon)), None)
        if block:
            initials, long = list(block), [x for x in long if x[0] != block]
    if not long or len(long) > 3:
        return []
    if len(long) == 1:
        core = long[0][0]
        if core in lexicon.given or len(core) < 4:
            return []
        if initials:
            return [Reading(f"I|{initials[0]}", core, "initial")]
        return [Reading("S|", core, "none")] if owned or len(kept) < len(tokens) else []
    options = [(w, _given(w, dot, lexicon)) for w, dot, _ in long]
    given = [i for i, (_, g) in enumerate(options) if g]
    if not given:
        options = [(w, g or lexicon.near(w)) for w, g in options]
        given = [i for i, (_, g) in enumerate(options) if g]
    if len(given) == len(long):  # a family name that is also a given name
        before_comma = [i for i, (_, _, p) in enumerate(long) if 0 <= comma and p < comma]
        given = [i for i in given if i not in before_comma] if before_comma else given[:-1]
    rest = [w for i, (w, _) in enumerate(options) if i not in given]
    if given and rest:
        names = options[given[0]][1]
        core = "".join(rest)
        if len(names) == 1:
            return [Reading(f"P|{next(iter(names))}", core, "full")]
        return [Reading(f"N|{' '.join(sorted(names))}", core, "some")]
    words = [w for w, _ in options]
    if len(words) != 2:
        return []
    if 0 <= comma:
        return [Reading(f"P|{words[1]}", words[0], "full")]
    return [Reading(f"P|{words[0]}", words[1], "full"), Reading(f"P|{words[1]}", words[0], "full")]


_FOLDED_SMALL = frozenset(map(fold, _SMALL))
_FOLDED_FORMS = frozenset(map(fold, FORMS)) | {"s", "sc", "a"}
#: Forms that may also be short for a word of a kind, as in "Savings Co.".
_SHORTENING_FORMS = frozenset(map(fold, ("co", "corp"))) | {"s", "sc", "a"}
_FOLDED_TITLES = frozenset(map(fold, TITLES))
_FOLDED_DEGREES = frozenset(map(fold, DEGREES))


def _plain_words(name: str) -> list[str]:
    """Words of a name of two to four plain words, without a number; else none."""
    t = re.sub(r"\s+No\. \d+$", "", name).split(" ")
    return t if 2 <= len(t) <= 4 and all(re.fullmatch(r"[^\W\d_]{2,}", w) for w in t) else []


def _two_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last words of two-word names, with the first one's first letter."""
    for b in batches:
        rows = []
        for name in b.column("name").to_pylist():
            t = _plain_words(name)
            if len(t) == 2 and fold(t[0]) not in _FOLDED_TITLES:
                rows.append((fold(t[0]), fold(t[1]), t[0][0].lower()))
        cols = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["first", "last", "letter"])


def _given_names(names: DataFrame) -> DataFrame:
    """``(word, letter)`` of the words that are given names.

    A given name stands before more family names than a family name has given names;
    an organisation's own word stands before fewer kinds than a kind has own words.
    So only comparisons within the names count.
    """
    pairs = cut(names.mapInArrow(_two_words, "first string, last string, letter string").groupBy("first", "last").agg(F.min("letter").alias("letter")))
    behind = pairs.groupBy("last").agg(F.count(F.lit(1)).alias("behind"))
    first = pairs.join(behind, "last").groupBy("first").agg(F.count(F.lit(1)).alias("n"), F.avg("behind").alias("behind"), F.min("letter").alias("letter"))
    last = behind.select(F.col("last").alias("first"), F.col("behind").alias("as_last"))
    kept = first.where(F.col("n") > GIVEN_NAMES_RATIO * F.col("behind")).join(last, "first", "left").where("n > 3 * coalesce(as_last, 0)")
    return kept.select(F.col("first").alias("word"), "letter")


def _phrases(people: frozenset[str]):
    """First words and the phrases after them, without forms of companies, and whether a given name is among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, agents, typed in zip(*(b.column(c).to_pylist() for c in ("name", "agents", "typed"))):
                t = [w for w in map(fold, _plain_words(name)) if w not in _FOLDED_SMALL and w not in _FOLDED_FORMS]
                if len(t) > 1 and len(t[0]) > 3 and t[0] not in _FOLDED_TITLES:
                    out.append((t[0], " ".join(t[1:]), not people.isdisjoint(t), agents, typed))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["own", "words", "person", "agents", "typed"])

    return run


def _kind_phrases(names: DataFrame, people: frozenset[str]) -> DataFrame:
    """``(words, count, thing)`` of the phrases that are kinds of organisations, in the names given; thing if most names with it are typed as something else.

    A kind is shared by own words that are no spellings of one another, by more of
    them than there are phrases after each on average (a family name has fewer given
    names than these have family names), and by more than it has given names. These
    are comparisons within the names, so more names of the same sort change nothing.
    """
    read = names.mapInArrow(_phrases(people), "own string, words string, person boolean, agents bigint, typed bigint")
    pairs = cut(read.groupBy("own", "words", "person").agg(F.sum("agents").alias("agents"), F.sum("typed").alias("typed")))
    others = pairs.where("NOT person").groupBy("own").agg(F.count(F.lit(1)).alias("phrases"))
    shared = pairs.where("NOT person").join(others, "own").groupBy("words").agg(
        F.count(F.lit(1)).alias("count"), F.avg("phrases").alias("phrases"), F.min("own").alias("low"), F.max("own").alias("high"),
        (2 * F.sum("agents") < F.sum("typed")).alias("thing"),
    )
    persons = pairs.where("person").groupBy("words").agg(F.count(F.lit(1)).alias("persons"))
    unlike = 2 * F.levenshtein("low", "high") > F.greatest(F.length("low"), F.length("high"))
    return shared.where(unlike & (F.col("count") > F.col("phrases"))).join(persons, "words", "left").where("count > coalesce(persons, 0)").select("words", "count", "thing")


def learn(names: DataFrame) -> tuple[dict[str, str], dict[str, frozenset[str]], list[tuple[str, bool]]]:
    """Given names and kinds that the names themselves show, with the given names that have known short forms."""
    short = {fold(k): frozenset(map(fold, v)) for k, v in SHORT_FORMS.items()}
    given = {fold(g): g[0] for g in sorted(GIVEN)}
    for w, letter in at_most(_given_names(names), MAX_GIVEN, "given names"):
        if w not in short:
            given.setdefault(w, letter)
    phrases = _kind_phrases(names, frozenset({*given, *short}))
    kinds = [tuple(r) for r in at_most(phrases.orderBy(F.desc("count"), "words").select("words", "thing"), MAX_KINDS, "kinds of organisations")]
    return given, short, kinds


def lexicon_of(given: dict[str, str], short: dict[str, frozenset[str]], phrases: list[tuple[str, bool]]) -> Lexicon:
    kinds = Kinds()
    for phrase, thing in phrases:
        kinds.add(tuple(phrase.split()), thing)
    return Lexicon(given, short, kinds)


def _reader(learned):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = lexicon_of(*learned.value)
        for b in batches:
            rows = [(n, *r, lexicon.given.get(g := r.grp[2:], g[:1]) if r.grp.startswith("P|") else "") for n in b.column("name").to_pylist() for r in read_name(n, lexicon)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["name", "grp", "core", "certainty", "letter"])

    return run


def allowed(length: int) -> int:
    """Edits between cores of this length."""
    return 0 if length < 5 else 1 if length < 8 else 2


class Trie:
    """Strings as nested dicts; the key "" holds a whole string."""

    def __init__(self, strings: list[str]) -> None:
        self.root: dict = {}
        for s in strings:
            node = self.root
            for c in s:
                node = node.setdefault(c, {})
            node[""] = s

    def within(self, word: str, most: int) -> list[tuple[str, int]]:
        """Strings at most ``most`` edits (loss, addition, change, swap of neighbours) away, with their distances.

        The automaton's states are sets of places in the word, one bit set for each
        number of edits so far; bit i stands for the first i letters being read.
        """
        length = len(word)
        masks: dict[str, int] = {}
        for i, c in enumerate(word, 1):
            masks[c] = masks.get(c, 0) | 1 << i
        full = (1 << (length + 1)) - 1
        goal = 1 << length
        start = [(1 << (d + 1)) - 1 & full for d in range(most + 1)]
        found, stack = [], [(self.root, start, None, "")]
        while stack:
            node, states, before, last = stack.pop()
            for c, child in node.items():
                if c == "":
                    d = next((d for d, s in enumerate(states) if s & goal), None)
                    if d is not None:
                        found.append((child, d))
                    continue
                mask = masks.get(c, 0)
                new = [(states[0] << 1) & mask]
                for d in range(1, most + 1):
                    s = (states[d] << 1) & mask | states[d - 1] | states[d - 1] << 1 | new[d - 1] << 1
                    if before is not None:
                        s |= (before[d - 1] << 2) & (mask << 1) & masks.get(last, 0)
                    new.append(s & full)
                if new[-1]:
                    stack.append((child, new, states, c))
        return found


def _walk(_key, index: pa.Table, probes: pa.Table) -> pa.Table:
    out: list[tuple] = []
    if index.num_rows and probes.num_rows:
        trie = Trie(index["core"].to_pylist())
        grp = index["grp"][0].as_py()
        for core in probes["probe"].to_pylist():
            out += [(grp, core, s, d) for s, d in trie.within(core, allowed(len(core))) if d <= allowed(len(s))]
    cols = list(zip(*out)) or [()] * 4
    return pa.table({"grp": pa.array(cols[0], pa.string()), "probe": pa.array(cols[1], pa.string()), "core": pa.array(cols[2], pa.string()), "d": pa.array(cols[3], pa.int32())})


def trie_join(index: DataFrame, probes: DataFrame) -> DataFrame:
    """``(grp, probe, core, d)``: cores of ``index(grp, core)`` near those of ``probes(grp, core)`` of the same group.

    A shard is a group and a length of core; probes go to the lengths their edits
    reach. Shards of more than TRIE_STRINGS cores become several tries.
    """
    index = index.select("grp", "core").distinct().withColumn("size", F.length("core"))
    large = index.groupBy("grp", "size").count().where(F.col("count") > TRIE_STRINGS)
    parts = large.select("grp", "size", F.ceil(F.col("count") / TRIE_STRINGS).cast("int").alias("parts"))
    index = index.join(parts, ["grp", "size"], "left").withColumn("part", F.pmod(F.xxhash64("core"), F.coalesce("parts", F.lit(1))).cast("int"))
    edit = F.when(F.length("core") < 5, 0).when(F.length("core") < 8, 1).otherwise(2)
    probes = probes.select("grp", "core").distinct().withColumn("size", F.explode(F.sequence(F.length("core") - edit, F.length("core") + edit)))
    probes = probes.join(parts, ["grp", "size"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    shard = ["grp", "size", "part"]
    other = probes.select(*[F.col(c).alias(f"probe_{c}") for c in shard], F.col("core").alias("probe"))
    tasks = tasks_for_cpu(index.sparkSession)
    left = index.select(*shard, "core").repartition(tasks, *shard).groupBy(*shard)
    return left.cogroup(other.repartition(tasks, *[f"probe_{c}" for c in shard]).groupBy(*[f"probe_{c}" for c in shard])).applyInArrow(_walk, "grp string, probe string, core string, d int")


def _nearest_links(read: DataFrame, near: DataFrame) -> DataFrame:
    """Links that are the shortest of the core with fewer names, the likelier misspelling; of either with equally many.

    So a misspelling joins what it is nearest to, and does not tie two entities together.
    """
    least = near.groupBy("grp", "probe").agg(F.min("d").alias("least"))
    held = read.groupBy("grp", "core").agg(F.count(F.lit(1)).alias("held"))
    side = least.join(held.withColumnRenamed("core", "probe"), ["grp", "probe"])
    both = near.where("probe < core").join(side, ["grp", "probe"]).join(side.select("grp", F.col("probe").alias("core"), F.col("least").alias("other_least"), F.col("held").alias("other_held")), ["grp", "core"])
    return both.where("(held <= other_held AND d = least) OR (other_held <= held AND d = other_least)")


def name_variants(names: DataFrame, agent_types: Collection[str] = (), other_types: Collection[str] = ()) -> DataFrame:
    """``(name, entity)``: names of persons and organisations, equal ``entity`` for spellings of one.

    ``names(name)``, or ``names(name, type)`` with the types that stand for persons and organisations
    and those that stand for other things; other values of type say nothing. Repeated names count once, nulls and names without letters are
    left out, and so are names that are neither person nor organisation (a single
    word; names of a kind that most often goes with other_types; without types all kinds pass for organisations). Given names and kinds of organisations are learned from all names
    by comparison with one another; cores of one class are linked up to ``allowed`` edits,
    a misspelling to what it is nearest to; links are transitive. A name with an initial, an ambiguous nickname or no given
    name joins a person only if exactly one given name fits it at the least
    distance; otherwise it stays by itself with its equals. Extra columns are ignored.
    """
    kind = F.col("type") if "type" in names.columns else F.lit(None).cast("string")
    rows = names.where(F.col("name").isNotNull()).select("name", kind.isin(*agent_types).alias("agent"), kind.isin(*agent_types, *other_types).alias("known"))
    distinct = cut(
        rows.groupBy("name")
        .agg(F.coalesce(F.sum(F.col("agent").cast("bigint")), F.lit(0)).alias("agents"), F.coalesce(F.sum(F.col("known").cast("bigint")), F.lit(0)).alias("typed"))
        .repartition(tasks_for_cpu(names.sparkSession), "name")
    )
    learned = names.sparkSession.sparkContext.broadcast(learn(distinct))
    read = cut(distinct.mapInArrow(_reader(learned), "name string, grp string, core string, certainty string, letter string"))
    node = F.concat_ws("|", "grp", "core")
    full = read.where("certainty = 'full'").select("grp", "core").distinct()
    near = _nearest_links(read, cut(trie_join(full, full).where("probe <> core"))).select(F.concat_ws("|", "grp", "probe").alias("a"), F.concat_ws("|", "grp", "core").alias("b"))

    persons = read.where("grp LIKE 'P|%'").select(F.substring_index("grp", "|", -1).alias("given"), "core", "letter").distinct()
    vague = read.where("certainty <> 'full'").select("grp", "core", "certainty").distinct()
    what = F.substring_index("grp", "|", -1)
    asked = vague.withColumn(  # one row for each class of persons that may be meant
        "asks",
        F.explode(
            F.when(F.col("certainty") == "initial", F.transform(F.split(what, ""), lambda c: F.concat(F.lit("I|"), c)))
            .when(F.col("certainty") == "some", F.transform(F.split(what, " "), lambda g: F.concat(F.lit("P|"), g)))
            .otherwise(F.array(F.lit("S|")))
        ),
    )
    bearers = persons.select(
        F.explode(F.array(F.concat(F.lit("I|"), "letter"), F.concat(F.lit("P|"), "given"), F.lit("S|"))).alias("asks"), F.col("core").alias("bearer"), "given"
    )
    reach = trie_join(bearers.select(F.col("asks").alias("grp"), F.col("bearer").alias("core")), asked.select(F.col("asks").alias("grp"), "core"))
    reach = reach.select(F.col("grp").alias("asks"), F.col("probe").alias("core"), F.col("core").alias("bearer"), "d")
    fits = asked.join(reach, ["asks", "core"]).join(bearers, ["asks", "bearer"]).select("grp", "core", "bearer", "d", "given")
    best = fits.groupBy("grp", "core").agg(F.min("d").alias("least"))
    chosen = (
        fits.join(best, ["grp", "core"]).where("d = least").groupBy("grp", "core")
        .agg(F.min("given").alias("given"), F.max("given").alias("other"), F.min("bearer").alias("bearer"))
        .where("given = other")
    )
    resolved = chosen.select(node.alias("a"), F.concat(F.lit("P|"), "given", F.lit("|"), "bearer").alias("b"))
    turned = read.groupBy("name").agg(F.min(node).alias("a"), F.max(node).alias("b")).where("a <> b").select("a", "b")
    groups = connected_components(near.unionByName(resolved).unionByName(turned))
    named = read.select("name", node.alias("node")).join(groups, "node", "left")
    return named.groupBy("name").agg(F.min(F.coalesce("component", "node")).alias("entity"))
