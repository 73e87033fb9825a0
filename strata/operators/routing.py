"""Which classifier sees an item, and whose verdict stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def route(items: DataFrame, registry: DataFrame, item: str) -> DataFrame:
    """item, classifier, precedence, rank: every classifier that claims one of the item's types.

    The registry has one row per type code, at most 256, hence the broadcast.
    """
    pairs = items.select(item, F.explode("types").alias("type_code")).join(F.broadcast(registry), "type_code")
    one = pairs.groupBy(item, "classifier").agg(F.min("precedence").alias("precedence"))
    ordered = one.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("precedence", "classifier"))).alias("c"))
    return ordered.select(item, F.posexplode("c").alias("at", "c")).select(item, "c.classifier", "c.precedence", (F.col("at") + 1).alias("rank"))


def unsupported(items: DataFrame, registry: DataFrame, item: str) -> DataFrame:
    """item, type_code, confidence -1 for every type that nobody claims."""
    pairs = items.select(item, F.explode("types").alias("type_code"))
    return pairs.join(F.broadcast(registry.select("type_code")), "type_code", "left_anti").select(item, "type_code", F.lit(-1).alias("confidence"))


def best_verdicts(verdicts: DataFrame, item: str) -> DataFrame:
    """Per item and classifier the verdict of highest confidence at or above the threshold; of equals the latest."""
    return satisfied(verdicts).groupBy(item, "classifier").agg(F.max(F.struct("confidence", "ord")).alias("m")).select(item, "classifier", "m.confidence", "m.ord")


def first_satisfied(best: DataFrame, registry: DataFrame, item: str) -> DataFrame:
    """The verdict of the classifier that comes first in precedence (ties by name)."""
    order = registry.groupBy("classifier").agg(F.min("precedence").alias("precedence"))
    ranked = best.join(F.broadcast(order), "classifier", "left").withColumn("precedence", F.coalesce("precedence", F.lit(2147483646)))
    return ranked.groupBy(item).agg(F.min(F.struct("precedence", "classifier", "confidence")).alias("m")).select(item, "m.classifier", "m.confidence")


def collect_all(verdicts: DataFrame, item: str) -> DataFrame:
    return verdicts.groupBy(item).agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s:%03d", "classifier", "confidence"))), " ").alias("verdicts"))


def reports_to_items(reports: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """Each report with the columns of the work item that it is about."""
    return reports.join(items, item)


def orphan_reports(reports: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """Reports about an item that is not (or no longer) waited for; a report without item is one too."""
    return reports.join(items.select(item).distinct(), item, "left_anti")


def with_thresholds(verdicts: DataFrame, own: DataFrame, default: int) -> DataFrame:
    """Verdicts with the ``threshold`` of their classifier: its own one (classifier, own: at most one row for each
    classifier, hence the broadcast), else the general one."""
    return verdicts.join(F.broadcast(own), "classifier", "left").withColumn("threshold", F.coalesce("own", F.lit(default))).drop("own")


def satisfied(verdicts: DataFrame) -> DataFrame:
    """Verdicts at or above their threshold."""
    return verdicts.where("confidence >= threshold")


def distinct_children(children: DataFrame, path: str, order: str) -> DataFrame:
    """Of children with the same path the first (of equal order the least of the other columns); null is a path of its own."""
    rest = [c for c in children.columns if c not in (path, order)]
    first = children.groupBy(path).agg(F.min(F.struct(order, *rest)).alias("first_"))
    return first.select(path, "first_.*").select(children.columns)


def shown_as_constant(confidence: Column, types: Column, constant: int) -> Column:
    """A node without a verdict of which one type is CONSTANT is shown as such."""
    return (confidence <= 0) & F.array_contains(types, constant)


def prunable_constant(results: Column, types: Column, constant: int) -> Column:
    """A node with exactly one result and no type but CONSTANT may be cut or dropped by a claim."""
    return (results == 1) & (types == F.array(F.lit(constant)))
