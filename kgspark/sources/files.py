"""Texts, examples and settings from files."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.text import language


def read_texts(spark: SparkSession, folder: str, suffixes: list[str] | None = None) -> DataFrame:
    """``(path, text)`` of all files under a folder; files that are no valid UTF-8 are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    if suffixes:
        raw = raw.where(F.lower("path").rlike("(?:" + "|".join(re.escape(s.lower()) for s in suffixes) + ")$"))
    return raw.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).where("text IS NOT NULL")


def load_inputs(spark: SparkSession, path: str, languages: list[str] | None = None) -> DataFrame:
    """``(text, lang)`` of .txt files and of .json files that hold a list or ``{"texts": [...]}``; stripped, empty ones dropped."""
    files = read_texts(spark, path, [".txt", ".json"])
    is_json = F.lower("path").endswith(".json")
    items = F.coalesce(F.from_json("text", "array<string>"), F.from_json("text", "struct<texts: array<string>>")["texts"])
    texts = files.select(F.explode(F.when(is_json, items).otherwise(F.array("text"))).alias("text"))
    texts = texts.select(F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("text")).where("text <> ''").withColumn("lang", language(F.col("text")))
    return texts.where(F.col("lang").isin(*languages)) if languages else texts


def read_examples(spark: SparkSession, paths: dict[str, str], lang: str = "english") -> DataFrame:
    """Few-shot examples of ``{task: file}``; missing files are skipped with a warning."""
    import warnings

    out = None
    item = "struct<id: string, input_text: string, output: string, metadata: map<string, string>, quality_rating: int>"
    for task, path in paths.items():
        if not os.path.exists(path):
            warnings.warn(f"no examples for {task} at {path}", stacklevel=2)
            continue
        doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<version: string, examples: array<{item}>>").alias("d"))
        one = doc.select(F.explode("d.examples").alias("e")).select(F.lit(task).alias("task"), "e.*").where(F.coalesce(F.col("metadata")["language"], F.lit("english")) == lang)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], f"task string, id string, input_text string, output string, metadata map<string, string>, quality_rating int")


def with_environment(text: str) -> str:
    """``${NAME}`` places replaced by environment variables; unset ones are an error."""
    return re.sub(r"\$\{(\w+)\}", lambda m: os.environ[m.group(1)], text)


def read_config(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(with_environment(f.read())) or {}


@dataclass
class Settings:
    """Knobs of the engine that are kept in a file."""

    language: str = "english"
    embedder_token_limit: int = 8_192
    context_token_limit: int = 30_000
    top_k: int = 20

    def save(self, path: str) -> None:
        with open(path + ".tmp", "w", encoding="utf-8") as f:
            json.dump(asdict(self), f)
        os.replace(path + ".tmp", path)

    @classmethod
    def load(cls, path: str) -> "Settings":
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        kinds = {f.name: type(f.default) for f in fields(cls)}
        for k, v in raw.items():
            if k not in kinds or type(v) is not kinds[k]:
                raise ValueError(f"setting {k} is unknown or of the wrong type")
        return cls(**raw)
