"""Splitting of oversized texts at natural boundaries, with overlap.

A text is read as a tree: sections (a heading and what follows it), paragraphs,
lines or list items, sentences, words. Sibling subtrees are merged bottom-up as
long as they fit into one piece together; only nodes that are too large by
themselves are opened. A run of words without any boundary is cut by count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.batches import slices
from kgspark.storage import spread

_WORD = re.compile(r"\S+")
_END = re.compile(r"[.!?…。！？؟।॥]+[\"'”’»›)\]}」』]*$")
_OPENING = "\"'“„‚«‹([{¿¡—–-"
_HEADING = re.compile(r"\s*(?:#{1,6}\s|[=\-]{3,}\s*$)")
_MAY_END = frozenset(".!?…。！？؟।॥\"'”’»›)]}」』")
_LINE_BREAKS = frozenset("\n\r\v\f\x1c\x1d\x1e\x85  ")

# Words before whose full stop a sentence rarely ends.
_ABBREVIATIONS = frozenset(
    """approx cf vol no nr mr mrs ms dr prof st jr sr capt lt col gen rev hon fig figs eq sec ch pp ed eds etc vs viz
    e.g i.e a.m p.m b d bzw ca usw d.h z.b u.a o.ä vgl bd hr fr dipl ing jh v.chr n.chr jun sen
    art m mm mme mlle etc p.ex cap av env sra srta dra ej p.ej núm pág ud uds aprox
    им ул см стр т.е т.д т.п г гг в вв д-ра д-р др проф рис ок напр руб коп тыс млн""".split()
)


def _ends_sentence(word: str, after: str | None) -> bool:
    """Whether a sentence ends with ``word`` when ``after`` follows in the same line."""
    if after is None:
        return True
    m = _END.search(word)
    if not m:
        return False
    first = after.lstrip(_OPENING)[:1]
    if first.islower():
        return False
    if set(m.group()) & set("!?。！？؟।॥"):
        return True
    stem = word[: m.start()].lstrip(_OPENING).lower()
    if m.group().startswith(".") and (stem in _ABBREVIATIONS or len(stem) == 1 and stem.isalpha()):
        return False
    return bool(stem)


# A node is (first word, last word + 1, children); leaves have no children.
def _leaf(a: int, b: int) -> tuple:
    return (a, b, ())


def _node(children: list[tuple]) -> tuple:
    return children[0] if len(children) == 1 else (children[0][0], children[-1][1], tuple(children))


def parse(text: str) -> tuple[list[tuple[int, int]], tuple | None, int]:
    """Word spans, the structure tree over them, and the longest run without boundary."""
    spans = [m.span() for m in _WORD.finditer(text)]
    if not spans:
        return spans, None, 0
    sections: list[list[tuple]] = [[]]
    paragraph: list[tuple] = []
    line: list[tuple] = []
    begin = longest = 0
    for i, (a, b) in enumerate(spans):
        last = i + 1 == len(spans)
        if not last and text[b] == " " and spans[i + 1][0] == b + 1 and text[b - 1] not in _MAY_END:
            continue
        gap = "" if last else text[b : spans[i + 1][0]]
        breaks = sum(c in _LINE_BREAKS for c in gap.replace("\r\n", "\n"))
        if last or breaks or _ends_sentence(text[a:b], text[slice(*spans[i + 1])]):
            line.append(_leaf(begin, i + 1))
            longest = max(longest, i + 1 - begin)
            begin = i + 1
        if last or breaks:
            paragraph.append(_node(line))
            line = []
        if last or breaks > 1:
            if _HEADING.match(text[spans[paragraph[0][0]][0] :][:80]) and sections[-1]:
                sections.append([])
            sections[-1].append(_node(paragraph))
            paragraph = []
    return spans, _node([_node(s) for s in sections]), longest


def _pack(node: tuple, size: int) -> list[tuple[int, int]]:
    """Ranges of at most ``size`` words that cover the node, by merging siblings bottom-up."""
    a, b, children = node
    if b - a <= size:
        return [(a, b)]
    if not children:
        return [(x, min(x + size, b)) for x in range(a, b, size)]
    out: list[tuple[int, int]] = []
    for child in children:
        for x, y in _pack(child, size):
            if out and y - out[-1][0] <= size:
                out[-1] = (out[-1][0], y)
            else:
                out.append((x, y))
    return out


def split_text(text: str, limit: int = 200, overlap: int = 20) -> tuple[list[tuple[int, int]], str]:
    """Character ranges of the pieces, and ``natural`` or ``forced``.

    ``forced`` if more than ``limit`` words follow each other somewhere without line
    break or sentence end. Words are runs without white space. Every piece but the
    first begins with the last ``overlap`` words of the one before.
    """
    spans, tree, longest = parse(text)
    if tree is None:
        return [], "natural"
    if len(spans) <= limit:
        return [(spans[0][0], spans[-1][1])], "natural"
    ranges = _pack(tree, limit - overlap)
    # The first piece has no overlap to carry: it may take the next range too if both fit.
    while len(ranges) > 1 and ranges[1][1] - ranges[0][0] <= limit:
        ranges[:2] = [(ranges[0][0], ranges[1][1])]
    pieces = [(spans[max(0, a - overlap) if k else a][0], spans[b - 1][1]) for k, (a, b) in enumerate(ranges)]
    return pieces, "forced" if longest > limit else "natural"


def _splitter(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "content")):
            at, index, piece, size, kind = [], [], [], [], []
            for i, text in enumerate(b.column("content").to_pylist()):
                if len(text.split()) <= limit:
                    continue
                pieces, cut_kind = split_text(text, limit, overlap)
                if len(pieces) < 2:
                    continue
                for k, (x, y) in enumerate(pieces):
                    at.append(i)
                    index.append(k)
                    piece.append(text[x:y])
                    size.append(len(piece[-1].split()))
                    kind.append(cut_kind)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("row_id").take(rows), b.column("id").take(rows), pa.array(index, pa.int32()), pa.array(piece, pa.string()), pa.array(size, pa.int32()), pa.array(kind, pa.string())],
                names=["row_id", "source_id", "chunk_order_idx", "content", "num_tokens", "cut_kind"],
            )

    return run


def split_oversized(chunks: DataFrame, limit: int = 200, overlap: int = 20) -> DataFrame:
    """Pieces of every ``chunks(row_id, id, content)`` row of more than ``limit`` words.

    Result: ``(row_id, source_id, chunk_order_idx, content, num_tokens, cut_kind)``,
    pieces numbered from 0, each of at most ``limit`` words counted anew; whatever
    num_tokens the input has is not used. ``cut_kind`` as in ``split_text``. Null,
    empty and short contents give no row; repeated rows are split each; extra
    columns are ignored. Needs 0 <= overlap < limit. No shuffle.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    # n words need at least 2n - 1 characters, so shorter contents never reach Python.
    long_enough = spread(chunks.where(F.length("content") > 2 * limit).select("row_id", "id", "content"))
    return long_enough.mapInArrow(
        _splitter(limit, overlap),
        "row_id bigint, source_id string, chunk_order_idx int, content string, num_tokens int, cut_kind string",
    )
