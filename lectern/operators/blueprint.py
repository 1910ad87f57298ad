"""Blueprints of exam papers: sections, their problems, marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECTION = "paper string, seq int, name string, type string, count int, marks_each int, instructions string, attempt int"


def section_problems(sections: DataFrame) -> DataFrame:
    """Sections with the list of what is wrong with each; a second section of a name is the wrong one."""
    again = F.row_number().over(W.partitionBy("paper", F.lower(F.trim("name"))).orderBy("seq")) > 1
    checks = [
        F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "blank name"),
        F.when(again & (F.trim("name") != ""), "name used twice"),
        F.when(F.col("count") < 1, "no questions"),
        F.when(F.col("marks_each") < 1, "no marks"),
        F.when((F.col("attempt") < 0) | (F.col("attempt") > F.col("count")), "cannot attempt so many"),
    ]
    return sections.withColumn("problems", F.array_compact(F.array(*checks)))


def paper_marks(sections: DataFrame) -> DataFrame:
    counted = F.when(F.col("attempt") > 0, F.col("attempt")).otherwise(F.col("count"))
    return sections.groupBy("paper").agg(F.sum(counted * F.col("marks_each")).alias("marks"), F.sum("count").alias("questions"))
