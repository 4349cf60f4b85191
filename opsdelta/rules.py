"""Pluggable rules: functions from tables to findings, known to the catalog."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import fixed

CATEGORY_OF = {rule: category for rule, category, _ in fixed.RULE_CATALOG}


class Registry:
    """Rules by id; each adds its findings to one lazy union."""

    def __init__(self, categories: dict[str, str] | None = None):
        self.categories = CATEGORY_OF if categories is None else categories
        self.rules: dict[str, Callable[..., DataFrame]] = {}

    def register(self, rule_id: str, category: str, fn: Callable[..., DataFrame]) -> None:
        """Refuses an unknown or repeated id and a category the catalog denies."""
        if rule_id not in self.categories:
            raise ValueError(f"{rule_id} is not in the rule catalog")
        if rule_id in self.rules:
            raise ValueError(f"{rule_id} is registered twice")
        if self.categories[rule_id] != category:
            raise ValueError(f"{rule_id} belongs to {self.categories[rule_id]}, not {category}")
        self.rules[rule_id] = fn

    def activations(self, disabled: list[str] = ()) -> list[tuple[str, bool]]:
        return [(rule, rule not in disabled) for rule in sorted(self.rules)]

    def run(self, *inputs, disabled: list[str] = ()) -> DataFrame:
        """Union of the enabled rules' findings with rule id and category."""
        parts = [
            self.rules[rule](*inputs)
            .withColumn("rule_id", F.lit(rule))
            .withColumn("category", F.lit(self.categories[rule]))
            for rule, enabled in self.activations(disabled)
            if enabled
        ]
        if not parts:
            raise ValueError("every rule is disabled")
        return reduce(DataFrame.unionByName, parts)
