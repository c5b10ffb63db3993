"""Groups of texts that are edited copies of one another.

A text's fingerprint is a row of small integers, the low bytes of minima over its
word shingles; the Hamming distance of two fingerprints estimates their Jaccard
distance. Texts are put into shards by bands of further minima, so that texts as
alike as the threshold meet in a shard almost surely. Each shard holds a BK-tree
over its fingerprints: children hang below their parent by Hamming distance, and a
search follows only edges whose distance lies within the radius of its own.
Pairs within the radius are then compared by their exact shingle sets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.batches import slices
from kgspark.operators.components import connected_components
from kgspark.storage import cut, spread

_WORD = re.compile(r"[^\W_]+")
_CACHE_WORDS = 500_000
_KEY = ("key_1", "key_2")  # 128 bits of hash that stand for a text
#: Members of a shard that one tree holds; larger shards are cut into blocks, each searched in the trees of all.
SHARD_MEMBERS = 20_000


@dataclass(frozen=True)
class NearDuplicateSpec:
    """Shingle length, least Jaccard similarity, and the size of the sketch.

    A pair at the threshold s shares a shard with probability
    1 - (1 - s**rows) ** bands, and lies within the radius, which is ``spread``
    standard deviations above its expected distance.
    """

    words: int = 5
    threshold: float = 0.8
    rows: int = 3
    bands: int = 36
    positions: int = 32
    spread: float = 3.2

    @property
    def radius(self) -> int:
        far = 1 - self.threshold
        return math.ceil(self.positions * far + self.spread * math.sqrt(self.positions * far * (1 - far)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class _Words:
    """64-bit hashes of words, kept for frequent reuse."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, text: str | None) -> list[int]:
        known, out = self.known, []
        for w in _WORD.findall((text or "").lower()):
            h = known.get(w)
            if h is None:
                if len(known) >= _CACHE_WORDS:
                    known.clear()
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return out


def _shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hashes of all runs of ``words`` consecutive entries."""
    n = len(hashes) - words + 1
    acc = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(words):
        acc = acc * np.uint64(0x100000001B3) + _mix(hashes[k : k + n] + np.uint64(k))
    return _mix(acc)


def _batch_shingles(texts: list, words: int, cache: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row, where each text's begin, and which texts have any."""
    per_text = [cache.of(t) for t in texts]
    counts = np.array([len(p) for p in per_text], dtype=np.int64)
    flat = np.fromiter((h for p in per_text for h in p), dtype=np.uint64, count=int(counts.sum()))
    all_runs = _shingles(flat, words)
    have = np.maximum(counts - words + 1, 0)
    word_at = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
    usable = np.flatnonzero(have)
    pick = np.repeat(word_at[usable], have[usable]) + (np.arange(have[usable].sum()) - np.repeat(np.cumsum(have[usable]) - have[usable], have[usable]))
    starts = (np.cumsum(have[usable]) - have[usable]).astype(np.int64)
    return all_runs[pick] if len(pick) else np.zeros(0, np.uint64), starts, usable


def _sketch(spec: NearDuplicateSpec):
    factor = np.random.default_rng(1).integers(1, 2**63, spec.bands * spec.rows + spec.positions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for b in (part for whole in batches for part in slices(whole, "text")):
            runs, starts, usable = _batch_shingles(b.column("text").to_pylist(), spec.words, cache)
            if not len(usable):
                continue
            minima = [np.minimum.reduceat(_mix(runs * f), starts) for f in factor]
            bands = []
            for i in range(spec.bands):
                key = np.full(len(usable), i, dtype=np.uint64)
                for m in minima[i * spec.rows : (i + 1) * spec.rows]:
                    key = _mix(key * np.uint64(31) + m)
                bands.append(key)
            shard = np.stack(bands, axis=1).astype(np.uint64).view(np.int64)
            print_ = np.ascontiguousarray(np.stack([(m & np.uint64(255)).astype(np.uint8) for m in minima[spec.bands * spec.rows :]], axis=1))
            n = len(usable)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("node").take(pa.array(usable)),
                    *(b.column(c).take(pa.array(usable)) for c in _KEY),
                    pa.Array.from_buffers(pa.binary(spec.positions), n, [None, pa.py_buffer(print_.tobytes())]).cast(pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * spec.bands), pa.array(shard.ravel())),
                ],
                names=["node", *_KEY, "fingerprint", "shards"],
            )

    return sketch


def _tree_pairs(prints: np.ndarray, members: np.ndarray, radius: int, tree_members: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members within the radius, from a BK-tree over them (or ``tree_members``) built and searched at once.

    Work items are (searching members, subtree members); the subtree's first member
    is its root, the others hang below it by their distance to the root.
    """
    work = [(members, members if tree_members is None else tree_members)]
    while work:
        searching, tree = work.pop()
        root = tree[0]
        d_search = np.count_nonzero(prints[searching] != prints[root], axis=1)
        near = searching[d_search <= radius]
        near = near[near != root]
        if len(near):
            yield np.full(len(near), root), near
        if len(tree) == 1:
            continue
        below = tree[1:]
        d_tree = np.count_nonzero(prints[below] != prints[root], axis=1)
        order = np.argsort(d_tree, kind="stable")
        edges, at = np.unique(d_tree[order], return_index=True)
        for edge, child in zip(edges, np.split(below[order], at[1:])):
            follow = searching[np.abs(d_search - edge) <= radius]
            if len(follow):
                work.append((follow, child))


def _links(pairs: list[tuple[np.ndarray, np.ndarray]], node: np.ndarray) -> np.ndarray:
    """Distinct pairs of different nodes, the smaller first."""
    if not pairs:
        return np.zeros((0, 2), np.int64)
    x, y = (node[np.concatenate(c)] for c in zip(*pairs))
    found = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
    return found[found[:, 0] != found[:, 1]]


def _shard_pairs(spec: NearDuplicateSpec, most: int):
    """Pairs of rows that come in order of their shard; a shard of more than ``most`` rows only gives (null, shard)."""

    def whole_shards(t: pa.Table) -> np.ndarray:
        shard, node = t["shard"].to_numpy(), t["node"].to_numpy()
        prints = np.frombuffer(b"".join(t["fingerprint"].to_pylist()), dtype=np.uint8).reshape(-1, spec.positions)
        at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        size = np.diff(np.r_[at, len(shard)])
        two = at[size == 2]
        near = np.count_nonzero(prints[two] != prints[two + 1], axis=1) <= spec.radius
        pairs = [(two[near], two[near] + 1)]
        for a, n in zip(at[size > 2], size[size > 2]):
            members = np.arange(a, a + n)
            pairs += _tree_pairs(prints, members, spec.radius)
        return _links(pairs, node)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None  # rows of the last shard so far
        large = None

        def give(t: pa.Table) -> Iterator[pa.RecordBatch]:
            found = whole_shards(t)
            for i in range(0, len(found), 50_000):
                part = found[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], names=["a", "b"])

        for b in batches:
            t = pa.Table.from_batches([b])
            if large is not None:
                t = t.filter(pa.array(t["shard"].to_numpy() != large))
            if not t.num_rows:
                continue
            large = None
            t = t if kept is None else pa.concat_tables([kept, t])
            shard = t["shard"].to_numpy()
            begins = int(np.searchsorted(shard, shard[-1]))
            if begins:
                yield from give(t.slice(0, begins))
            kept = t.slice(begins)
            if kept.num_rows > most:
                large, kept = shard[-1], None
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([large], pa.int64())], names=["a", "b"])
        if kept is not None and kept.num_rows:
            yield from give(kept)

    return run


def _block_pairs(spec: NearDuplicateSpec):
    def run(_key, t: pa.Table) -> pa.Table:
        node, block = t["node"].to_numpy(), t["block"].to_numpy()
        prints = np.frombuffer(b"".join(t["fingerprint"].to_pylist()), dtype=np.uint8).reshape(-1, spec.positions)
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        searching, tree = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = _links(list(_tree_pairs(prints, searching, spec.radius, tree)) if len(searching) and len(tree) else [], node)
        return pa.table({"a": found[:, 0].copy(), "b": found[:, 1].copy()})

    return run


def _large_shards(sharded: DataFrame, large: DataFrame, spec: NearDuplicateSpec, most: int) -> DataFrame:
    """Pairs inside shards of more than ``most`` members, block against block."""
    rows = sharded.join(large, "shard")
    blocks = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks"))
    rows = rows.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pair = lambda o: F.struct(F.least(F.col("block"), o).alias("i"), F.greatest(F.col("block"), o).alias("j"))
    rows = rows.withColumn("p", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair))).select("shard", "p.i", "p.j", "block", "node", "fingerprint")
    return rows.groupBy("shard", "i", "j").applyInArrow(_block_pairs(spec), "a bigint, b bigint")


def _verify(spec: NearDuplicateSpec):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs(text: str) -> set:
            w = _WORD.findall((text or "").lower())
            return set(zip(*(w[k:] for k in range(spec.words))))

        for b in (part for whole in batches for part in slices(whole, "text_a", "text_b")):
            a, c = b.column("text_a").to_pylist(), b.column("text_b").to_pylist()
            keep, last, last_runs = [], None, set()
            for i, (x, y) in enumerate(zip(a, c)):
                if x is not last and x != last:
                    last, last_runs = x, runs(x)
                other = runs(y)
                both = len(last_runs & other)
                if both and both >= spec.threshold * (len(last_runs) + len(other) - both):
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return verify


def near_duplicate_links(texts: DataFrame, spec: NearDuplicateSpec = NearDuplicateSpec(), shard_members: int = SHARD_MEMBERS) -> tuple[DataFrame, DataFrame]:
    """Links between different texts that are alike, and which text each row has.

    ``texts(node, text_id, text)`` with a unique bigint node for each row. Rows of equal
    text are one class, named by its smallest node and compared once, however many there are. Two texts are alike if their sets of ``spec.words`` consecutive words
    (runs of letters and digits, lower-cased) share at least ``spec.threshold`` of
    their union. Returns ``(links(a, b), members(node, text_id))``: links between classes, a < b, each
    once, and the different text_ids of each class. Null and empty texts and texts of fewer words have no shingles and so
    are in neither. Rows without node are ignored; extra columns too.
    """
    rows = texts.where(F.col("node").isNotNull() & F.col("text").isNotNull()).select("node", "text_id", "text", F.xxhash64("text").alias("key_1"), F.xxhash64(F.lit(1), "text").alias("key_2"))
    sketches = spread(rows).mapInArrow(_sketch(spec), "node bigint, key_1 bigint, key_2 bigint, fingerprint binary, shards array<bigint>")
    one = cut(sketches.groupBy(*_KEY).agg(F.min("node").alias("node"), F.first("fingerprint").alias("fingerprint"), F.first("shards").alias("shards")))
    members = rows.select(*_KEY, "text_id").distinct().join(one.select(*_KEY, "node"), list(_KEY)).select("node", "text_id")
    sharded = one.select("node", "fingerprint", F.explode("shards").alias("shard"))
    in_order = sharded.repartition("shard").sortWithinPartitions("shard")
    found = cut(in_order.mapInArrow(_shard_pairs(spec, shard_members), "a bigint, b bigint").distinct())
    candidates, large = found.where("a IS NOT NULL"), found.where("a IS NULL").select(F.col("b").alias("shard"))
    if large.limit(1).count():
        candidates = cut(candidates.unionByName(_large_shards(sharded, large, spec, shard_members)).distinct())
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    content = rows.select("node", "text").join(wanted, "node")
    pairs = (
        candidates.join(content.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .join(content.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    return cut(pairs.mapInArrow(_verify(spec), "a bigint, b bigint")), members


def near_duplicate_groups(texts: DataFrame, spec: NearDuplicateSpec = NearDuplicateSpec()) -> DataFrame:
    """``(text_id, group_id, n_links)`` for each text that another text_id has too or has one like it; see near_duplicate_links.

    n_links counts text_ids of equal and of alike texts. A text_id with several texts gives a row for each.
    """
    links, members = near_duplicate_links(texts, spec)
    members = cut(members)
    sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(sizes, both["b"] == sizes["node"]).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("alike"))
    groups = connected_components(links)
    classes = (
        sizes.join(degree, "node", "left")
        .join(groups, "node", "left")
        .select("node", F.coalesce("component", "node").alias("group_id"), (F.coalesce("alike", F.lit(0)) + F.col("n") - 1).alias("n_links"))
        .where("n_links > 0")
    )
    return members.join(classes, "node").select("text_id", "group_id", "n_links")
