"""Text functions as column expressions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BREAK = r"\n+|(?<=[.!?])\s+"


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fragments(text: Column) -> Column:
    """Pieces of a description: lines, and sentences inside them; empty ones dropped."""
    return F.filter(F.transform(F.split(text, _BREAK), squeeze), lambda x: x != "")


def distinct_fragments(pieces: Column) -> Column:
    """First-seen pieces; case makes no difference. Quadratic in one row's pieces only."""
    keys = F.transform(pieces, F.lower)
    return F.filter(pieces, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def merge_descriptions(texts: Column) -> Column:
    """All fragments of an array of texts, each once, joined by a space."""
    return F.array_join(distinct_fragments(F.flatten(F.transform(texts, lambda t: F.coalesce(fragments(t), F.array().cast("array<string>"))))), " ")


def type_key(name: Column) -> Column:
    """Type name for comparison: what stands before " (", upper case, words joined by _."""
    head = F.regexp_replace(name, r"(?s) \(.*$", "")
    return F.array_join(F.filter(F.split(F.upper(F.regexp_replace(head, "[-_]", " ")), r"\s+"), lambda x: x != ""), "_")


def clean_type(kind: Column) -> Column:
    """Stripped type without its remark; UNKNOWN if nothing is left."""
    bare = F.trim(F.element_at(F.split(kind, r" \("), 1))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("UNKNOWN"))


def valid_strength(strength: Column, low: int = 0, high: int = 5) -> Column:
    return strength.isNotNull() & strength.between(low, high)


def words(text: Column, least: int = 2, stop: list[str] | None = None) -> Column:
    """Lower-case words of at least ``least`` characters that are no numbers and no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    found = F.filter(found, lambda w: (F.length(w) >= least) & ~w.rlike(r"^[0-9]+$"))
    return F.filter(found, lambda w: ~w.isin(*stop)) if stop else found


def label_name(kind: Column) -> Column:
    """A type as a label of letters, digits and _; led by _ if it begins with a digit; ENTITY if empty."""
    safe = F.regexp_replace(F.trim(kind), r"[^A-Za-z0-9_]", "_")
    safe = F.when(safe.rlike("^[0-9]"), F.concat(F.lit("_"), safe)).otherwise(safe)
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("ENTITY"))


def group_label(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def first_words(text: Column, budget: int) -> Column:
    """The first ``budget`` words; shorter texts as they are."""
    parts = F.split(F.trim(text), r"\s+")
    return F.when(F.size(parts) <= budget, text).otherwise(F.array_join(F.slice(parts, 1, budget), " "))


def preview(text: Column, characters: int) -> Column:
    return F.when(F.length(text) > characters, F.concat(F.substring(text, 1, characters), F.lit("..."))).otherwise(text)


def json_size(*columns: Column) -> Column:
    """Bytes of the row as JSON."""
    return F.octet_length(F.to_json(F.struct(*columns)))


def cache_key(*columns: Column) -> Column:
    """Key of a request: sha-256 of its canonical JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def render(template: str, **values: Column) -> Column:
    """A template with ``{{ name }}`` places, one row each; an unknown name is an error."""
    import re

    pieces, at = [], 0
    for m in re.finditer(r"\{\{\s*(\w+)\s*\}\}", template):
        if m.group(1) not in values:
            raise KeyError(f"template needs a value for {m.group(1)}")
        pieces += [F.lit(template[at : m.start()]), values[m.group(1)].cast("string")]
        at = m.end()
    return F.concat(*pieces, F.lit(template[at:]))


def splice_before_last(messages: Column, shots: Column) -> Column:
    """Example messages before the last message."""
    n = F.size(messages)
    return F.when(n == 0, shots).otherwise(F.concat(F.slice(messages, 1, F.greatest(n - 1, F.lit(0))), shots, F.slice(messages, n, F.lit(1))))


def close_match(known: list[str], cutoff: float = 0.85):
    """Scalar function: the known name nearest by difflib's ratio, or null below the cutoff."""

    @F.pandas_udf("string")
    def match(value: pd.Series) -> pd.Series:
        seen = {v: next(iter(difflib.get_close_matches(v, known, 1, cutoff)), None) for v in value.dropna().unique()}
        return value.map(seen)

    return match


# Frequent words of a language.
FREQUENT_WORDS = {
    "en": "the and of was in by to that is for with on as his her had not from were which at it he she",
    "de": "der die und von wurde den das dem des ein eine nicht mit sich auf zu im ist als auch war nach bei hatte",
    "fr": "le et fut du les une des dans est pas que qui sur avec pour au aux sont ce cette il elle ne par",
    "es": "el y los fue del una las que con por para no es se su al como más pero sus le ya lo había",
}


def language(text: Column) -> Column:
    """Language by script, and for Latin script by frequent small words; ``und`` if nothing tells."""
    padded = F.concat(F.lit(" "), F.lower(F.regexp_replace(text, r"[^\p{L}]+", " ")), F.lit(" "))
    share = lambda ws: sum((F.length(padded) - F.length(F.regexp_replace(padded, f" (?:{'|'.join(ws)})(?= )", ""))) for ws in [ws])
    scores = {k: share(v.split()) for k, v in FREQUENT_WORDS.items()}
    top = F.greatest(*scores.values())
    out = F.when(text.rlike(r"[぀-ヿ]"), "ja").when(text.rlike(r"[一-鿿]"), "zh").when(text.rlike(r"\p{IsCyrillic}"), "ru")
    out = out.when(text.rlike(r"\p{IsArabic}"), "ar").when(text.rlike(r"\p{IsDevanagari}"), "hi").when(text.rlike(r"\p{IsThai}"), "th")
    for k, s in scores.items():
        out = out.when((s == top) & (s > 0), k)
    return out.otherwise("und")


def embedding_text(name: Column, description: Column) -> Column:
    """Text that is embedded for a row: name and description, or the one that is there."""
    return F.when(name.isNull(), description).when(description.isNull(), name).otherwise(F.concat(name, F.lit(" - "), description))


def row_json(*columns: Column) -> Column:
    """A row as JSON, nested structs, lists and maps included; nulls are left out."""
    return F.to_json(F.struct(*columns))


def encode_properties(properties: dict[str, Column], native: set[str]) -> Column:
    """Properties as a map of strings: those of ``native`` names as they are, all others as JSON."""
    pairs = []
    for name, value in properties.items():
        pairs += [F.lit(name), value.cast("string") if name in native else F.when(value.isNotNull(), F.to_json(F.struct(value.alias("v"))))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def decode_property(properties: Column, name: str, kind: str, native: bool) -> Column:
    """A property of a map of ``encode_properties``, by its declared type; null where it is missing or not of that type."""
    text = properties[name]
    return text.try_cast(kind) if native else F.from_json(text, f"v {kind}")["v"]


def truncate_words(text: Column, budget: int, reserved: int = 0) -> Column:
    """The first words up to a budget, less the places reserved for special tokens; an empty text stays empty."""
    return F.when(F.trim(text) == "", F.lit("")).otherwise(first_words(text, max(0, budget - reserved)))
