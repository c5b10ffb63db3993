"""Prompts and the texts that go into them, as column expressions."""

from __future__ import annotations

import colorsys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import first_words, render


@dataclass
class Prompts:
    """Named templates with the values they need; a copy may override some."""

    templates: dict[str, str] = field(default_factory=dict)

    def override(self, **templates: str) -> "Prompts":
        unknown = set(templates) - set(self.templates)
        if unknown:
            raise KeyError(f"no such prompts: {sorted(unknown)}")
        return Prompts({**self.templates, **templates})

    def render(self, name: str, **values: Column) -> Column:
        return render(self.templates[name], **values)


DEFAULT = Prompts(
    {
        "extract": "List the entities and relations of this text as JSON.\n\n{{ text }}",
        "summarise": "Write one description from these notes.\n\n{{ notes }}",
        "report": "Write a report on this group.\n\n{{ members }}",
        "answer": "Answer from the context only.\n\n{{ context }}\n\nQuestion: {{ query }}",
        "decompose": "Split into sub-questions with ids and what each depends on.\n\n{{ query }}",
    }
)


def messages(system: Column | None, user: Column) -> Column:
    """Chat messages as an array of ``(role, content)``."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(message("user", user)) if system is None else F.array(message("system", system), message("user", user))


def few_shot(examples: DataFrame, shape: str = "pairs") -> DataFrame:
    """``(query_id, shots)`` of ranked ``examples(query_id, rank, input_text, output)``: ``pairs`` of messages, ``numbered``, ``plain`` or ``json`` text."""
    x = examples.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "input_text", "output"))).alias("x"))
    if shape == "pairs":
        pair = lambda e: F.array(F.struct(F.lit("user").alias("role"), e["input_text"].alias("content")), F.struct(F.lit("assistant").alias("role"), e["output"].alias("content")))
        return x.select("query_id", F.flatten(F.transform("x", pair)).alias("shots"))
    line: dict[str, Callable[[Column, Column], Column]] = {
        "numbered": lambda e, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit("\nInput: "), e["input_text"], F.lit("\nOutput: "), e["output"]),
        "plain": lambda e, i: F.concat(e["input_text"], F.lit("\n"), e["output"]),
        "json": lambda e, i: F.to_json(F.struct(e["input_text"].alias("input"), e["output"].alias("output"))),
    }
    return x.select("query_id", F.array_join(F.transform("x", line[shape]), "\n\n").alias("shots"))


def context_text(rows: DataFrame, title: str, line: Column, budget: int | None = None) -> DataFrame:
    """``(query_id, context)``: lines of ranked rows under a title, cut to a number of words."""
    text = rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda r: r["line"]), "\n").alias("lines"))
    whole = F.concat(F.lit(f"# {title}\n"), F.col("lines"))
    return text.select("query_id", (whole if budget is None else first_words(whole, budget)).alias("context"))


def deltas(answer: Iterator[str], query: str, retrieval: object = None) -> Iterator[dict]:
    """Events of an answer that comes in pieces; the last one holds the whole."""
    whole = ""
    for piece in answer:
        whole += piece
        yield {"query": query, "retrieval": retrieval, "delta": piece, "payload": None}
    yield {"query": query, "retrieval": retrieval, "delta": "", "payload": whole}


def colours(n: int) -> list[str]:
    """n well separated colours: hues by steps of the golden ratio."""
    golden = (5**0.5 - 1) / 2
    return ["#" + "".join(f"{round(255 * c):02x}" for c in colorsys.hsv_to_rgb(i * golden % 1, 0.6, 0.95)) for i in range(n)]
