"""Token budgets: keep the longest prefix of a ranked result that fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pack(ranked: DataFrame, budget, order: list, tokens: str = "tokens") -> DataFrame:
    """Rows of an already limited result whose running token total stays in budget.

    Every row costs at least one token, so the running total only grows and
    "stop at the first row that does not fit" is a plain filter. The input is a
    top-k result, so the single window partition holds k rows.
    """
    running = F.sum(tokens).over(
        Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return ranked.withColumn("running_tokens", running).filter(F.col("running_tokens") <= budget)


def pack_two_stage(files: DataFrame, symbols: DataFrame, budget: int,
                   file_order: list, symbol_order: list, tokens: str = "tokens") -> DataFrame:
    """Files first, then symbols go on from the tokens the kept files used.

    Returns `kind, rank, tokens, running_tokens, kept` for all rows, so that a caller
    sees the kept prefix and whether anything was cut.
    """
    ranked_files = files.select(
        F.lit("file").alias("kind"), F.lit(0).alias("stage"), "item_id", F.col(tokens).alias("tokens"),
        F.row_number().over(Window.orderBy(*file_order)).alias("rank"),
    )
    ranked_symbols = symbols.select(
        F.lit("symbol").alias("kind"), F.lit(1).alias("stage"), "item_id", F.col(tokens).alias("tokens"),
        F.row_number().over(Window.orderBy(*symbol_order)).alias("rank"),
    )
    own = Window.partitionBy("stage").orderBy("rank").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    both = ranked_files.unionByName(ranked_symbols).withColumn("own_total", F.sum("tokens").over(own))
    everything = Window.orderBy("stage").rangeBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(
        F.sum(F.when(F.col("own_total") <= budget, F.col("tokens"))).over(everything), F.lit(0)
    )
    return (
        both.withColumn("running_tokens", F.col("own_total") + spent)
        .withColumn("kept", F.col("running_tokens") <= budget)
        .select("kind", "item_id", "rank", "tokens", "running_tokens", "kept")
    )
