"""A catalogue of models: sizes read from names, expected speed, order of choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A measured speed, in tokens a second, and the parameters it was measured at, in billions.
SPEED, AT = 9.8, 8.2
#: What names of models that only embed or rerank hold.
NO_CHAT = r"(?i)embed|rerank|bge|minilm|e5-"


def parameters(size: Column) -> Column:
    """Billions of parameters of texts like ``8.2B`` or ``567M``, or null."""
    number = F.regexp_extract(size, r"([0-9]+(?:\.[0-9]+)?)\s*([bBmM])", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(size, r"([0-9]+(?:\.[0-9]+)?)\s*([bBmM])", 2))
    return F.when(unit == "M", number / 1000).otherwise(number)


def expected_speed(billions: Column) -> Column:
    """Tokens a second, in inverse proportion to the parameters."""
    return F.when(billions > 0, F.round(F.lit(SPEED * AT) / billions, 1))


def catalogue(models: DataFrame) -> DataFrame:
    """Models (name, size) in the order to offer them: those that can chat first, larger ones first."""
    rows = models.withColumns({"chat": ~F.col("name").rlike(NO_CHAT), "billions": parameters(F.col("size"))})
    return rows.withColumn("speed", expected_speed(F.col("billions"))).orderBy(F.desc("chat"), F.desc_nulls_last("billions"), "name")
