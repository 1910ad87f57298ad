"""Blueprints and past-paper profiles as files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.operators.blueprint import SECTION

# What a blueprint has that does not say otherwise.
TITLE, DURATION, TOTAL_MARKS = "End-Semester Examination", "3 Hours", 70
SECTION_DEFAULTS = {"type": "short", "count": 5, "marks_each": 2, "instructions": "", "attempt": 0}
BLUEPRINT = "paper string, title string, duration string, total_marks int, bloom_mix map<string,double>"


def _tables(spark: SparkSession, paper: str, tree: dict) -> tuple[DataFrame, DataFrame]:
    sections = []
    for i, s in enumerate(tree.get("sections") or []):
        s = SECTION_DEFAULTS | {"name": f"Section {i + 1}"} | {k: v for k, v in s.items() if v is not None}
        sections.append((paper, i, str(s["name"]), str(s["type"]), int(s["count"]), int(s["marks_each"]), str(s["instructions"]), int(s["attempt"])))
    mix = {k: float(v) for k, v in (tree.get("bloom_mix") or {}).items()}
    head = [(paper, tree.get("title", TITLE), tree.get("duration", DURATION), int(tree.get("total_marks", TOTAL_MARKS)), mix)]
    return spark.createDataFrame(head, BLUEPRINT), spark.createDataFrame(sections, SECTION)


def load_blueprint(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A blueprint of a JSON or YAML file, and its sections; the file's name is that of the paper."""
    text = Path(path).read_text(encoding="utf-8")
    if Path(path).suffix in (".yaml", ".yml"):
        import yaml  # only for files in that format

        return _tables(spark, Path(path).stem, yaml.safe_load(text) or {})
    return _tables(spark, Path(path).stem, json.loads(text))


def blueprint_of(spark: SparkSession, cfg: Config, paper: str = "paper") -> tuple[DataFrame, DataFrame]:
    """The blueprint that the settings name."""
    return _tables(spark, paper, cfg.get("paper", {}))


def save_blueprint(blueprint: DataFrame, sections: DataFrame, path: str) -> None:
    """One paper, at most a few dozen sections, as a JSON file that ``load_blueprint`` reads."""
    head = blueprint.first().asDict()
    rows = sections.where(F.col("paper") == head.pop("paper")).orderBy("seq").drop("paper", "seq").collect()
    Path(path).write_text(json.dumps(head | {"sections": [r.asDict() for r in rows]}, indent=2), encoding="utf-8")


def save_profile(profile: DataFrame, path: str) -> None:
    """Profiles as lines of JSON."""
    profile.write.json(path)


def load_profile(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.json(path) if schema is None else spark.read.schema(schema).json(path)
