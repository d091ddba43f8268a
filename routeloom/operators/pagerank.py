"""PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .network import Network, per_slot, prepare


def pagerank(network: Network, alpha: float = 0.85, tol: float = 1e-6, max_iter: int = 100) -> DataFrame:
    """(id, pagerank): uniform start and teleport, mass of dangling nodes spread uniformly.

    Stops once the summed change falls below ``tol`` times the number of nodes. A round shuffles
    one value per node and the partial sums per target; the edges stay where they are. Ranks that have not settled
    after ``max_iter`` rounds are an error.
    """
    g = prepare(network, "pagerank")
    n = g.n
    if n == 0:
        return network.vertices.select("id", F.lit(0.0).alias("pagerank"))
    change = F.sum(F.abs(F.col("rank") - F.col("previous")))
    dangling = F.coalesce(F.sum(F.when(F.col("out_degree") == 0, F.col("rank"))), F.lit(0.0))
    state, seen = g.workspace.save_counted(
        g.vertices.select("id", "out_degree", "out_slots", F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("previous")),
        "start", change=change, dangling=dangling,
    )
    for turn in range(max_iter):
        if turn and seen["change"] < n * tol:
            break
        sent = per_slot(
            state.filter("out_degree > 0").select(
                F.col("id").alias("src"), "out_slots", (F.col("rank") / F.col("out_degree")).alias("share")
            ),
            "out_slots",
            "out_slot",
        )
        inflow = g.forward(sent).groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("inflow"))
        base = alpha * seen["dangling"] / n + (1.0 - alpha) / n
        state, seen = g.workspace.save_counted(
            state.join(inflow, "id", "left").select(
                "id",
                "out_degree",
                "out_slots",
                (F.coalesce("inflow", F.lit(0.0)) * alpha + base).alias("rank"),
                F.col("rank").alias("previous"),
            ),
            f"rank-{turn % 2}", change=change, dangling=dangling,
        )
    else:
        if seen["change"] >= n * tol:
            g.release()
            raise RuntimeError(f"PageRank has not converged within {max_iter} rounds")
    g.release()
    return g.named(state.select("id", F.col("rank").alias("pagerank")))
