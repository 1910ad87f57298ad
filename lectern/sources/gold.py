"""Gold cases and question banks as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = {"question": "string", "answerable": "boolean", "book": "string", "pages": "array<int>", "keywords": "array<string>", "reviewed": "boolean", "notes": "string"}
SCHEMA = ", ".join(f"{k} {v}" for k, v in FIELDS.items())


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Cases with a ``problem`` where a line is not one: not JSON, an unknown field, a wrong type, no
    question. Blank lines and those that begin with # are skipped."""
    lines = spark.read.text(path).where(~F.trim("value").rlike(r"^(#.*)?$"))
    raw = F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys("value")
    unknown = F.array_except(keys, F.array(*map(F.lit, FIELDS)))
    rows = lines.select("value", raw.alias("c"), keys.alias("keys"), unknown.alias("unknown"))
    wrong = [F.when(F.array_contains("keys", k) & F.col(f"c.{k}").isNull() & (F.coalesce(F.get_json_object("value", f"$.{k}"), F.lit("null")) != "null"), F.lit(k)) for k in FIELDS]
    problem = (
        F.when(F.col("keys").isNull(), "not a JSON object")
        .when(F.size("unknown") > 0, F.concat(F.lit("unknown field "), F.get("unknown", F.lit(0))))
        .when(F.coalesce(*wrong).isNotNull(), F.concat(F.lit("wrong type of "), F.coalesce(*wrong)))
        .when(F.coalesce(F.trim("c.question"), F.lit("")) == "", "no question")
    )
    return rows.select("c.*", problem.alias("problem"))


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """Valid cases, or an error that names the first problem."""
    cases = read_gold(spark, path)
    bad = cases.where("problem is not null").first()
    if bad is not None:
        raise ValueError(f"{path}: {bad['problem']}")
    if cases.isEmpty():
        raise ValueError(f"{path}: no cases")
    return cases.drop("problem")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
