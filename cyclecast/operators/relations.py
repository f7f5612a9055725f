"""Joins that check what they assume, equality of tables with repeats, and paths up a tree of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, which has to have each key once; the job fails where a row meets a repeated one.

    Repeats are counted in the aggregation that the join needs anyway, so there is no pass of its own and
    a repeated key that no row of ``left`` asks for does no harm. Null keys meet nothing.
    """
    if how not in ("left", "inner"):
        raise ValueError("how is left or inner")
    others = [c for c in right.columns if c not in keys]
    once = right.groupBy(*keys).agg(F.count("*").alias("_n"), F.any_value(F.struct(F.lit(True).alias("_there"), *others)).alias("_r"))
    told = F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several rows on the right for "), told))).otherwise(F.col("_r"))
    joined = left.join(once, keys, how).withColumn("_r", checked)
    return joined.select(*left.columns, *(F.col("_r")[c].alias(c) for c in others))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows that one table has more often, with ``surplus``: how much more often ``left`` has them.

    Columns are those of ``left``; order plays no part, repeats do, and nulls are equal. One shuffle.
    """
    columns = left.columns
    if sorted(columns) != sorted(right.columns):
        raise ValueError(f"columns differ: {sorted(set(columns) ^ set(right.columns))}")
    both = left.withColumn("surplus", F.lit(1)).unionByName(right.select(columns).withColumn("surplus", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("surplus").alias("surplus")).where("surplus <> 0")


def layout_checks(observed: DataFrame, planned: DataFrame, name: str, key: str) -> DataFrame:
    """Per layout ``name`` of ``planned``: what sets it apart from ``observed``, by ``key`` and by whole rows.

    n_missing and n_unknown keys, n_repeated keys, n_surplus and n_lacking rows (repeats count), and same.
    """
    layouts = planned.select(name).distinct()
    each = observed.crossJoin(F.broadcast(layouts)).select(name, *observed.columns)  # a few layouts
    rows = each.withColumns({"_o": F.lit(1), "_p": F.lit(0)}).unionByName(planned.select(name, *observed.columns).withColumns({"_o": F.lit(0), "_p": F.lit(1)}))
    kinds = rows.groupBy(name, *observed.columns).agg(F.sum("_o").alias("_o"), F.sum("_p").alias("_p"))
    keys = kinds.groupBy(name, key).agg(F.sum("_o").alias("_o"), F.sum("_p").alias("_p"), F.sum(F.greatest(F.col("_p") - F.col("_o"), F.lit(0))).alias("more"), F.sum(F.greatest(F.col("_o") - F.col("_p"), F.lit(0))).alias("less"))
    found = keys.groupBy(name).agg(
        F.count_if(F.col("_p") == 0).alias("n_missing"), F.count_if(F.col("_o") == 0).alias("n_unknown"), F.count_if(F.col("_p") > 1).alias("n_repeated"), F.sum("more").alias("n_surplus"), F.sum("less").alias("n_lacking")
    )
    return found.withColumn("same", (F.col("n_surplus") == 0) & (F.col("n_lacking") == 0))


def ancestors(parents: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(node, ancestor, depth)`` of ``parents(node, parent)``, all the way up; roots have a null or empty parent.

    Pointer doubling: a round joins what each node knows with what those know, so it takes as many rounds
    as the logarithm of the depth. Raises where a node has two parents or is its own ancestor.
    """
    edges = parents.where("parent is not null and parent <> ''").select("node", F.col("parent").alias("ancestor")).distinct()
    found = edges.withColumn("depth", F.lit(1).cast("long")).checkpoint()
    if not found.groupBy("node").count().where("count > 1").isEmpty():
        raise ValueError("a node has two parents")
    reach = 1
    for _ in range(max_rounds):
        bad = found.where("node = ancestor").first()
        if bad:
            raise ValueError(f"{bad.node} is its own ancestor")
        tops = found.where(F.col("depth") == reach)  # what is as far as was looked
        if tops.isEmpty():
            return found
        above = found.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_a"), F.col("depth").alias("_d"))
        further = tops.join(above, "ancestor").select("node", F.col("_a").alias("ancestor"), (F.col("depth") + F.col("_d")).alias("depth"))
        found, reach = found.unionByName(further).checkpoint(), 2 * reach
    raise ValueError(f"deeper than {2**max_rounds} levels")
