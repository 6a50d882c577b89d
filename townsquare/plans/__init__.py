"""The jobs bound to the sample tables, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Plan(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def all_plans() -> dict[str, Plan]:
    from townsquare.plans import extract, graphs, ingest, search, temporal, topics, words

    plans: dict[str, Plan] = {}
    for module in (temporal, ingest, extract, search, words, graphs, topics):
        plans.update(module.PLANS)
    return plans
