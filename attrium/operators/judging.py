"""Findings that are kept up: rules say what they depend on, and only what a change touches is judged again."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .core import union_issues


class Rule(NamedTuple):
    """key: the columns of a row that its findings depend on; rows that share them are judged together. judge: gets
    rows and gives findings, with the columns of the key."""

    name: str
    key: tuple[str, ...]
    judge: Callable[[DataFrame], DataFrame]

    def depends(self) -> Column:
        return F.to_json(F.struct(*self.key))

    def findings(self, rows: DataFrame) -> DataFrame:
        """source_id (null if they are about a group), code, severity and details; rule and depends."""
        found = self.judge(rows).withColumns({"depends": self.depends(), "rule": F.lit(self.name)})
        absent = {c: F.lit(None).cast("string") for c in ("source_id", "details") if c not in found.columns}
        return found.withColumns(absent).select("source_id", "code", "severity", "details", "rule", "depends")


def judged(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    return union_issues(*[r.findings(rows) for r in rules])


def judged_again(found: DataFrame, before: DataFrame, after: DataFrame, touched: DataFrame, rules: list[Rule]) -> DataFrame:
    """The findings of `after`, from those of `before`; touched: source_id of the rows that differ, came or went.
    Of each rule only the keys of touched rows, as they were and as they are, are judged."""
    some = lambda df: df.join(touched.select("source_id").distinct(), "source_id", "left_semi")
    out = []
    for rule in rules:
        keys = some(before).select(rule.depends().alias("depends")).unionByName(some(after).select(rule.depends().alias("depends"))).distinct()
        again = after.withColumn("depends", rule.depends()).join(keys, "depends", "left_semi").drop("depends")
        out.append(found.filter(F.col("rule") == rule.name).join(keys, "depends", "left_anti").select("source_id", "code", "severity", "details", "rule", "depends"))
        out.append(rule.findings(again))
    return union_issues(*out)
