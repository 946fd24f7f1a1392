"""Rules as a table function of SQL: ``SELECT * FROM rule_positions(TABLE(panel) PARTITION BY entity ORDER BY (date), 17)``."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..deploy import ship
from . import rules


@cache
def _kernel(rule_id: int) -> rules.Kernel:
    """The rule made ready, once for all entities of a worker."""
    chosen = next((r for r in rules.manifest() if r.rule_id == rule_id), None)
    if chosen is None:
        raise ValueError(f"no rule {rule_id}")
    return rules.Kernel([chosen])


class RulePositions:
    """Daily positions of the rule with a number of the manifest, over one entity's rows in order of date."""

    def __init__(self):
        self.rows, self.rule = [], None

    def eval(self, row, rule_id: int):
        self.rows.append((row["entity"], row["date"], row["close"], row["vol"]))
        self.rule = rule_id

    def terminate(self):
        if not self.rows:
            return
        number = lambda i: np.array([np.nan if r[i] is None else float(r[i]) for r in self.rows])
        for (entity, date, *_), pos in zip(self.rows, _kernel(self.rule).positions(number(2), number(3))[:, 0]):
            yield entity, date, self.rule, int(pos)


def register(spark: SparkSession, name: str = "rule_positions") -> None:
    """Makes the function known to the session's SQL. Its table has entity (long), date, close and vol."""
    ship(spark)
    spark.udtf.register(name, udtf(RulePositions, returnType="entity long, date date, rule_id int, pos byte"))
