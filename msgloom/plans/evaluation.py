"""The evaluation loop: gold and predictions in, metrics and the next round's failures out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from msgloom.operators import evaluate
from msgloom.sources.staging import staged


def run_evaluation(gold: DataFrame, predictions: DataFrame, key: str = "scenario_id") -> tuple[DataFrame, DataFrame]:
    """One row of metrics, and the failures that the next plan is made from; rows are scored once for both and staged."""
    scored = staged(evaluate.score(gold, predictions, key))
    return evaluate.metrics(scored), evaluate.next_round(evaluate.failures(scored), key)
