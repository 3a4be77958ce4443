"""The bulk-synchronous loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from graphloom.plans.config import RunConfig, cut


def run(
    state: DataFrame, step: Callable[[DataFrame, int], DataFrame], halted: Callable[[DataFrame], bool] | None = None, config: RunConfig | None = None,
) -> tuple[DataFrame, int]:
    """Apply ``step(state, superstep)`` until ``halted(state)``, and return the state and the supersteps run.

    With ``halted`` each superstep is materialised, as its data decide whether another follows, and the
    last one, in which nothing changes, counts. Without it ``config.max_supersteps`` are chained and
    materialised every ``checkpoint_every``.
    """
    config = config or RunConfig()
    n = 0
    while config.max_supersteps is None or n < config.max_supersteps:
        state = step(state, n)
        n += 1
        if halted is not None:
            state = cut(state)
            if halted(state):
                break
        elif n % config.checkpoint_every == 0 and n != config.max_supersteps:
            state = cut(state)
    return state, n
