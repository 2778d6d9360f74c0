"""Rollback decisions kept up to date by micro-batches of closed windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators.rates import asked_signals, on_grid, signals_of_rates
from ..operators.slo import rollback_decision
from ..params import EvalGrid, RollbackLimits
from ..session import written


def decision_sink(
    targets: DataFrame, path: str, start_us: int, step_us: int, limits: RollbackLimits = RollbackLimits()
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over ``stream_rates`` of all three metrics: a decision for every target and every
    evaluation from ``start_us`` on, as it is closed, in <path>/out/batch=<id>.

    A closed window comes with all its series in one micro-batch. Evaluations that no series saw are judged too
    (unavailable): the last one judged is kept in <path>/closed/batch=<id>. A batch that is run again reads the
    mark before it and overwrites its own folders.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = written(batch, "closed-windows")  # each further use would run the stateful step again
        newest = batch.agg(F.max(F.unix_micros("eval_ts"))).first()[0]
        before = start_us - step_us
        if batch_id > 0:
            before = spark.read.schema("us bigint").json(f"{path}/closed/batch={batch_id - 1}").first().us
        closed = max(before, newest if newest is not None else before)
        if closed > before:
            grid = EvalGrid(before + step_us, closed, step_us)
            signals = asked_signals(on_grid(targets, grid), signals_of_rates(batch))
            rollback_decision(signals, limits).write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")
        spark.range(1).select(F.lit(closed).alias("us")).write.mode("overwrite").json(f"{path}/closed/batch={batch_id}")

    return apply
