"""Fitted models as tables: linear weights and tree nodes that anything can score from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleet_health.functions import scalars as S

#: `feature` is null in the row of the constant. `fill` stands for a missing value.
LINEAR_SCHEMA = "feature string, fill double, weight double"
#: A leaf has no feature; rows with feature <= threshold go left. Node 0 is a tree's root.
NODE_SCHEMA = "tree int, node int, feature string, threshold double, left int, right int, value double, fill double"


def linear_table(spark, columns: Sequence[str], fills: dict, weights: Sequence[float], constant: float) -> DataFrame:
    rows = [(c, fills.get(c), float(w)) for c, w in zip(columns, weights)]
    return spark.createDataFrame([*rows, (None, None, float(constant))], LINEAR_SCHEMA)


def _value(name: str, fill) -> Column:
    x = F.col(f"`{name}`").cast("double")
    return F.coalesce(F.when(~F.isnan(x), x), F.lit(fill).cast("double"))


def linear_score(table: DataFrame) -> Column:
    """The weighted sum of the features; the table has one row per feature, so it is read at once."""
    total = F.lit(0.0)
    for r in sorted(table.collect(), key=lambda r: r["feature"] or ""):
        total = total + (F.lit(r["weight"]) if r["feature"] is None else F.lit(r["weight"]) * _value(r["feature"], r["fill"]))
    return total


def linear_probability(table: DataFrame) -> Column:
    return S.logistic(linear_score(table))


def tree_table(model, columns: Sequence[str], fills: dict, spark) -> DataFrame:
    """The nodes of a fitted tree ensemble; leaf values carry the weight of their tree."""
    rows = []

    def walk(node, tree, weight):
        at = sum(r[0] == tree for r in rows)
        rows.append(None)
        slot = len(rows) - 1
        rows[slot] = (tree, at, None, None, None, None, None, None)
        if node.subtreeDepth() == 0:
            rows[slot] = (tree, at, None, None, None, None, float(node.prediction()) * weight, None)
        else:
            name = columns[node.split().featureIndex()]
            left = walk(node.leftChild(), tree, weight)
            right = walk(node.rightChild(), tree, weight)
            rows[slot] = (tree, at, name, float(node.split().threshold()), left, right, None, fills.get(name))
        return at

    for i, tree in enumerate(model.trees):
        walk(tree._java_obj.rootNode(), i, float(model.treeWeights[i]))
    return spark.createDataFrame(rows, NODE_SCHEMA)


def tree_value(nodes: DataFrame) -> Column:
    """The sum over the trees of the leaf that a row reaches, as one expression.

    The nodes are as many as the model has, which its number and depth of trees bound, so they are
    read at once. A missing feature without a fill goes right.
    """
    trees: dict = {}
    for r in nodes.collect():
        trees.setdefault(r["tree"], {})[r["node"]] = r

    def reached(tree, at) -> Column:
        r = tree[at]
        if r["feature"] is None:
            return F.lit(r["value"]).cast("double")
        return F.when(_value(r["feature"], r["fill"]) <= F.lit(r["threshold"]), reached(tree, r["left"])).otherwise(
            reached(tree, r["right"]))

    total = F.lit(0.0)
    for tree in sorted(trees):
        total = total + reached(trees[tree], 0)
    return total


def mean_tree(rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """A regression tree without search: level i splits every node at its mean of features[i].

    Leaves hold the mean target. One aggregation per level; 2 ** levels groups at most. Rows need
    all features and the target; a node without rows on one side has a null leaf there.
    """
    x = rows.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("_y"))
    x = x.dropna().withColumn("_node", F.lit(0))
    kept = []
    for name in features:
        means = x.groupBy("_node").agg(F.avg(name).alias("_mean"))
        kept.append(means.select(F.lit(0).alias("tree"), F.col("_node").alias("node"), F.lit(name).alias("feature"),
                                 F.col("_mean").alias("threshold"), (2 * F.col("_node") + 1).alias("left"),
                                 (2 * F.col("_node") + 2).alias("right"), F.lit(None).cast("double").alias("value"),
                                 F.lit(None).cast("double").alias("fill")))
        x = x.join(F.broadcast(means), "_node").withColumn(
            "_node", 2 * F.col("_node") + F.when(F.col(name) <= F.col("_mean"), 1).otherwise(2)).drop("_mean")
    leaves = x.groupBy("_node").agg(F.avg("_y").alias("value")).select(
        F.lit(0).alias("tree"), F.col("_node").alias("node"), F.lit(None).cast("string").alias("feature"),
        F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("int").alias("left"),
        F.lit(None).cast("int").alias("right"), "value", F.lit(None).cast("double").alias("fill"))
    out = leaves
    for level in kept:
        out = out.unionByName(level)
    # Sides without rows: a leaf of null, so that every path ends.
    known = out.select("node").withColumn("_known", F.lit(True))
    asked = out.where(F.col("feature").isNotNull()).select(F.explode(F.array("left", "right")).alias("node"))
    missing = asked.join(F.broadcast(known), "node", "left_anti")
    return out.unionByName(missing.select("node", F.lit(0).alias("tree")), allowMissingColumns=True)


def means_as_linear(rows: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Weights without fitting: a feature's correlation with the label, by its deviation; fills are means.

    The constant puts the mean row at one half. Features without variation get weight 0.
    """
    stats = rows.agg(*[f for c in columns for f in (
        F.avg(c).alias(f"m_{c}"), F.coalesce(F.try_divide(F.corr(F.col(c).cast("double"), label), F.nullif(
            F.stddev_pop(c), F.lit(0.0))), F.lit(0.0)).alias(f"w_{c}"))])
    each = stats.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(f"m_{c}").alias("fill"), F.col(f"w_{c}").alias("weight")) for c in columns])))
    constant = each.agg(F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("fill"),
                        (-F.sum(F.col("fill") * F.col("weight"))).alias("weight"))
    return each.unionByName(constant)


PREDICTED = T.StructType([T.StructField("probability", T.DoubleType()), T.StructField("rul", T.DoubleType())])
