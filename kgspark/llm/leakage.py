"""Test items that occur, whole or in part, in documents of a corpus.

A short item is found inside a long document by MinHash containment. The sketch of
an item is the set of its window minima: every window as long as the shortest
passage that counts gives the least hash of its shingles. A document is sketched the
same way, so whatever passage both hold gives both the same minimum, however long
the document around it. Items are partitioned by size, each partition doubling the
last; the share of an item's sketch that a document holds estimates its containment,
and a document is a candidate if it reaches the least share that one passage makes in
the largest sketch of the partition. Candidates are verified exactly: a passage word by
word, and the containment from all shingles of the item.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.batches import slices
from kgspark.storage import spread

#: Words that count as a passage, and words of a shingle; the same in characters for scripts without spaces.
WORDS, WORD_SHINGLE = 10, 5
CHARS, CHAR_SHINGLE = 25, 13
#: Bytes of items whose index is broadcast at once; more are searched in several passes.
ITEM_BYTES_AT_ONCE = 32 << 20
_AT_ONCE = 1 << 18

_RUN = re.compile(r"[^\W_]+")
_SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑­][^\S\r\n]*(?:\r\n|[\r\n\v\f\x85  ])\s*(?=[^\W\d_])")
_UNSEEN = re.compile("[­͏؜​-‏‪-‮⁠-⁯︀-️﻿̀-゙゚ͯ]+")
_FOREIGN = re.compile("[Ͱ-ԯ]")
# Small letters of other alphabets that look like Latin ones.
_ALIKE = str.maketrans("аеорсухіјѕԁһԛԝвкмнтαοερνικτυχ", "aeopcyxijsdhqwbkmhtaoepvikтyx")


def plain(text: str) -> str:
    """Text without what a reader does not read: accents, case, invisible characters, line-end hyphens."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    if "\n" in text or "\r" in text or not text.isascii():
        text = _HYPHEN.sub("", text)
    text = text.casefold()
    if not text.isascii():
        text = _UNSEEN.sub("", text)
        if _FOREIGN.search(text):
            text = text.translate(_ALIKE)
    return text


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(30))


def _shingles(ids: np.ndarray, shingle: int) -> np.ndarray:
    m = max(0, len(ids) - shingle + 1)
    acc = np.zeros(m, np.uint64)
    for k in range(shingle):
        acc = acc * np.uint64(0x100000001B3) + ids[k : k + m].astype(np.uint64)
    return _mix(acc)


def window_minima(ids: np.ndarray, shingle: int, window: int) -> np.ndarray:
    """For each window of ids, the least hash of its shingles; windows that hold id 0 get the largest number."""
    n = len(ids) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    hashes = _shingles(ids, shingle)
    least = hashes[:n].copy()
    for k in range(1, window - shingle + 1):
        np.minimum(least, hashes[k : k + n], out=least)
    zeros = np.concatenate([[0], np.cumsum(ids == 0)])
    least[zeros[window:] - zeros[:n] > 0] = np.iinfo(np.uint64).max
    return least


class Partition:
    """Items of one script and size class: their sketches, and where each mark of a sketch comes from."""

    def __init__(self, marks: np.ndarray, places: np.ndarray, sketch_sizes: dict[int, int]) -> None:
        order = np.argsort(marks, kind="stable")
        self.marks, self.first = np.unique(marks[order], return_index=True)
        self.places = places[order]  # windows of each mark, one mark after the other
        self.first = np.append(self.first, len(order))
        self.sketch_sizes = sketch_sizes
        #: One passage makes at least this share of any sketch here.
        self.least_share = 1 / max(sketch_sizes.values())


class ItemIndex:
    """Items of one script: their units as numbers, in a row, and their partitions by size."""

    def __init__(self, items: list[tuple[int, list[str]]], shingle: int, window: int) -> None:
        self.shingle, self.window = shingle, window
        self.ids: dict[str, int] = {}
        self.items: list[int] = []
        starts, flat, classes = [0], [], {}
        for item, units in items:
            if len(units) < window:
                continue
            seq = np.array([self.ids.setdefault(u, len(self.ids) + 1) for u in units], np.int64)
            passages = np.lib.stride_tricks.sliding_window_view(seq, window)
            _, new = np.unique(passages, axis=0, return_index=True)  # equal passages of an item count once
            minima = window_minima(seq, shingle, window)
            size_class = int(len(seq) // window).bit_length()
            marks, places, sizes = classes.setdefault(size_class, ([], [], {}))
            marks.append(minima[new])
            places.append(new + starts[-1])
            sizes[len(self.items)] = len(np.unique(minima))
            self.items.append(item)
            flat.append(seq)
            starts.append(starts[-1] + len(seq))
        self.flat = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        self.starts = np.array(starts)
        self.partitions = [Partition(np.concatenate(m), np.concatenate(p), z) for _, (m, p, z) in sorted(classes.items())]
        self.marks = np.unique(np.concatenate([p.marks for p in self.partitions])) if self.partitions else np.zeros(0, np.uint64)
        self.by_code: np.ndarray | None = None
        if self.ids and all(len(u) == 1 for u in self.ids):
            self.by_code = np.zeros(0x110000, np.int32)
            for u, i in self.ids.items():
                self.by_code[ord(u)] = i

    def numbers(self, units: list[str] | str) -> np.ndarray:
        """Numbers of a document's units; 0 for what no item holds."""
        if self.by_code is not None and isinstance(units, str):
            return self.by_code[np.frombuffer(units.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        get = self.ids.get
        return np.fromiter((get(u, 0) for u in units), np.int64, len(units))

    def search(self, documents: list[np.ndarray]) -> Iterator[tuple[int, int, int, float]]:
        """(document's place, item, number of the item's passages it holds, share of the item's shingles it holds)."""
        if not self.items or not documents:
            return
        gap = np.zeros(1, np.int64)  # no window goes beyond its document
        flat = np.concatenate([x for d in documents for x in (d, gap)])
        ends = np.cumsum([len(d) + 1 for d in documents])
        least = window_minima(flat, self.shingle, self.window)
        hits = np.flatnonzero(self.marks[np.minimum(np.searchsorted(self.marks, least), len(self.marks) - 1)] == least)
        if not len(hits):
            return
        place = np.searchsorted(ends, hits, side="right")
        for part in self.partitions:
            at = np.minimum(np.searchsorted(part.marks, least[hits]), len(part.marks) - 1)
            here = np.flatnonzero(part.marks[at] == least[hits])
            yield from self._verified(part, flat, ends, hits[here], place[here], at[here])

    def _verified(self, part: Partition, flat: np.ndarray, ends: np.ndarray, hits: np.ndarray, place: np.ndarray, mark: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        many = part.first[mark + 1] - part.first[mark]
        sketched: list[np.ndarray] = []
        exact: list[np.ndarray] = []
        within = np.arange(self.window)
        cuts = np.searchsorted(np.cumsum(many), np.arange(_AT_ONCE, int(many.sum()) + _AT_ONCE, _AT_ONCE)) + 1 if len(many) else []
        begin = 0
        for end in cuts:
            end = min(int(end), len(many))
            if end <= begin:
                continue
            n = many[begin:end]
            of = np.repeat(np.arange(begin, end), n)
            window = part.places[np.repeat(part.first[mark[begin:end]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            item = np.searchsorted(self.starts, window, side="right") - 1
            sketched.append(np.unique(np.stack([place[of], item, mark[of]], axis=1), axis=0))
            same = (flat[hits[of][:, None] + within] == self.flat[window[:, None] + within]).all(axis=1)
            exact.append(np.unique(np.stack([place[of], item, window], axis=1)[same], axis=0))
            begin = end
        if not sketched:
            return
        pairs, shared = np.unique(np.unique(np.concatenate(sketched), axis=0)[:, :2], axis=0, return_counts=True)
        candidates = {(p, i) for (p, i), n in zip(pairs.tolist(), shared.tolist()) if n / part.sketch_sizes[i] >= part.least_share}
        pairs, passages = np.unique(np.unique(np.concatenate(exact), axis=0)[:, :2], axis=0, return_counts=True)
        last, theirs = -1, None
        for (p, i), n in zip(pairs.tolist(), passages.tolist()):
            if (p, i) in candidates:
                if p != last:
                    last, theirs = p, _shingles(flat[(ends[p - 1] if p else 0) : ends[p] - 1], self.shingle)
                own = np.unique(_shingles(self.flat[self.starts[i] : self.starts[i + 1]], self.shingle))
                yield p, self.items[i], n, float(np.isin(own, theirs).mean())


def build_indexes(items: list[tuple[int, str]]) -> tuple[ItemIndex, ItemIndex]:
    """Indexes by words and, for items in scripts without spaces, by characters."""
    by_words, by_chars = [], []
    for item, text in items:
        units = _RUN.findall(plain(text))
        if _SPACELESS.search(text):
            by_chars.append((item, list("".join(units))))
        else:
            by_words.append((item, units))
    return ItemIndex(by_words, WORD_SHINGLE, WORDS), ItemIndex(by_chars, CHAR_SHINGLE, CHARS)


def _searcher(indexes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chars = indexes.value
        for whole in batches:
            for b in slices(whole, "text"):
                texts = b.column("text").to_pylist()
                units = [_RUN.findall(plain(t)) for t in texts]
                rows = list(words.search([words.numbers(u) for u in units])) if words.items else []
                spaceless = [i for i, t in enumerate(texts) if _SPACELESS.search(t)] if chars.items else []
                rows += [(spaceless[p], *found) for p, *found in chars.search([chars.numbers("".join(units[i])) for i in spaceless])]
                place, item, n, share = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(place, pa.int64())), pa.array(item, pa.int64()), pa.array(n, pa.int64()), pa.array(share, pa.float64())],
                    names=["doc_id", "item_id", "n_windows", "containment"],
                )

    return run


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, n_windows, containment)`` for each item that a document holds in part or whole.

    ``documents(doc_id, text)``, ``items(item_id, text)``. A document holds an item
    if it has at least WORDS consecutive words of it, for items in scripts without spaces (kana, Han,
    Thai, Lao, Burmese, Khmer) CHARS consecutive letters or digits; case, accents, punctuation, layout, line-end
    hyphens, invisible and look-alike characters make no difference. n_windows is
    the number of the item's different passages of just that length in it, containment the share of the
    item's shingles that occur anywhere in the document.

    Every document and every window is searched. Null or empty texts and items that
    are shorter than a passage are in no pair; ids that are null are ignored.
    Repeated rows give one pair with the largest figures. Extra columns are
    ignored. The index of the items is built once and broadcast; items beyond ITEM_BYTES_AT_ONCE are searched in
    several passes over the documents.
    """
    spark = documents.sparkSession
    usable = items.where(F.col("item_id").isNotNull() & (F.length("text") > 0)).select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    size = usable.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // ITEM_BYTES_AT_ONCE))
    texts = spread(documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "text"))
    found = None
    for p in range(passes):
        block = usable.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p) if passes > 1 else usable
        index = spark.sparkContext.broadcast(build_indexes([tuple(r) for r in block.collect()]))
        part = texts.mapInArrow(_searcher(index), "doc_id bigint, item_id bigint, n_windows bigint, containment double")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("containment").alias("containment"))
