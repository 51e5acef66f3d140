"""Training-set assembly: sources in, a capped, balanced, anonymised set out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgloom.functions.anonymize import anonymize
from msgloom.operators import curate


def unique_rows(rows: DataFrame) -> DataFrame:
    """W1 and J7 in one exchange: the first row of each pair_key, kept sources before pool ones.

    A pool row whose key a kept source has is thereby gone; ``real`` says whether the key's
    first row in source order was.
    """
    order = Window.partitionBy("pair_key").orderBy(F.when(F.col("kind") == "keep", 0).otherwise(1), "source_ord", "row_ord")
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def assemble(rows: DataFrame, cap: int, negative_share: float, seed: int = 0) -> DataFrame:
    """Rows (pair_key, kind, real, source_ord, row_ord, is_schedule, events, message, thread_context, sender, ...) to the final set.

    Scores are computed before the cut and only narrow columns take part in it; texts join
    again by key for the rows that stay.
    """
    unique = unique_rows(rows)
    said = (F.col("is_schedule"), F.col("events"), F.col("message"), F.col("thread_context"))
    scored = unique.withColumns({"grounding": curate.grounding(*said), "difficulty": curate.difficulty(*said)})
    narrow = scored.select("pair_key", "kind", "real", "is_schedule", "grounding", "difficulty")
    chosen = curate.capped_selection(narrow, cap, negative_share, seed).select("pair_key", "grounding", "difficulty")
    final = unique.join(chosen, "pair_key").withColumn("events", curate.without_boilerplate(F.col("events")))
    return anonymize(final)
