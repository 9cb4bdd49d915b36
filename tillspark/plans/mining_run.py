"""A whole mining run: baskets, itemsets, rules, recommendations, all stored."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark.mining.job import Mined, mine
from tillspark.operators.baskets import baskets
from tillspark.operators.recommend import all_recommendations
from tillspark.operators.serve import stored_recommendations
from tillspark.schemas import MiningSettings
from tillspark.sinks.tables import load_run, read_recommendations, replace_recommendations, save_run


@dataclass(frozen=True)
class MiningRun:
    run_id: str
    mined: Mined
    recommendations: DataFrame


def run_mining(
    spark: SparkSession, lines: DataFrame, products: DataFrame, folder: str,
    settings: MiningSettings | None = None, created_by: str = "system", run_id: str | None = None,
    key: str | None = None,
) -> MiningRun:
    """Mine cleaned ``lines`` and store the run and its recommendations under ``folder``.

    ``products`` has the column name, ``key`` is as for ``baskets``. Raises ValueError when there are no baskets.
    """
    settings = settings or MiningSettings()
    run_id = run_id or uuid.uuid4().hex
    mined = mine(baskets(lines, key=key), settings)
    if mined.n_baskets == 0:
        raise ValueError("no transactions found; load retail lines first")
    save_run(mined, f"{folder}/mining", run_id, created_by)
    _, itemsets, rules = load_run(spark, f"{folder}/mining", run_id)
    stored = stored_recommendations(
        all_recommendations(itemsets, rules), products.select(F.col("name").alias("description")),
        settings.algorithm,
    )
    replace_recommendations(stored, f"{folder}/recommendations")
    kept = read_recommendations(spark, f"{folder}/recommendations").filter(
        F.col("algorithm") == settings.algorithm
    )
    return MiningRun(run_id, mined, kept)
