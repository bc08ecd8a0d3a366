"""Writers: partitions replaced as a whole, nested reports, delimited text that no spreadsheet runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estateloom.functions.keys import col


def overwrite_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces exactly the partitions that ``df`` has rows for; a run that is repeated leaves the same state."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def harmless_cell(c: Column | str) -> Column:
    """A cell that a spreadsheet would take for a formula gets an apostrophe in front."""
    return F.when(col(c).rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), col(c))).otherwise(col(c))


def write_answers(df: DataFrame, path: str) -> None:
    """Delimited text with a header, every text cell made harmless."""
    safe = [harmless_cell(f.name).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema]
    df.select(*safe).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def assessment_reports(claims: DataFrame) -> DataFrame:
    """(assessment_id, report): one nested JSON document per assessment: totals by entity type and attribute."""
    c = claims.dropDuplicates(["claim_id"]).withColumn("attribute", F.translate(F.lower("attribute"), " -", "__"))
    per = c.groupBy("assessment_id", "entity_type", "attribute").agg(F.count("*").alias("n"), F.count_if("is_selected").alias("selected"))
    types = per.groupBy("assessment_id", "entity_type").agg(F.array_sort(F.collect_list(F.struct("attribute", "n", "selected"))).alias("attributes"), F.sum("n").alias("n"))
    report = F.array_sort(F.collect_list(F.struct("entity_type", "n", "attributes")))
    return types.groupBy("assessment_id").agg(F.to_json(F.struct(F.sum("n").alias("n_claims"), report.alias("types"))).alias("report"))
