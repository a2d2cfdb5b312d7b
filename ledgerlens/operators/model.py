"""Gradient-boosted classifier on ledger features: fit with early stop, score, importance, attributions, counterfactuals."""

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import risk_level, risk_score
from ledgerlens.sources.scratch import shared_dir


@dataclass(frozen=True)
class Prepared:
    """How features become numbers: what stands for a NULL, which features have an indicator of one, and
    what a positive row weighs."""

    features: tuple[str, ...]
    floors: dict[str, float]
    marked: tuple[str, ...]
    weight: float

    @property
    def inputs(self) -> list[str]:
        return [f"{c}__x" for c in self.features] + [f"{c}__missing" for c in self.marked]

    @property
    def owners(self) -> list[int]:
        """For each input the place of the feature that it belongs to."""
        return [*range(len(self.features)), *[self.features.index(c) for c in self.marked]]


def prepare(df: DataFrame, how: Prepared) -> DataFrame:
    """NULLs become a value below the training minimum, marked by an indicator where the training rows
    have any: trees can split on either, and the classifier takes no NaN."""
    numbers = {f"{c}__x": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(how.floors[c])) for c in how.features}
    return df.withColumns(numbers | {f"{c}__missing": F.col(c).isNull().cast("double") for c in how.marked})


#: Most rows that one task of a fit holds (about 100 MB at 60 inputs), and what is dealt over up to eight tasks before.
TASK_ROWS, FEW_ROWS = 1 << 17, 1 << 13


def fit(
    train: DataFrame, features: Sequence[str], validation: DataFrame | None = None, rounds: int = 300, depth: int = 5, step: float = 0.1, tolerance: float = 1e-5, key: str = "event_id"
) -> tuple[PipelineModel, Prepared]:
    """Classes are weighted by their inverse frequency in ``train``.

    Rows become vectors once and are dealt by the hash of ``key``, in its order, over as many tasks as there
    are ``TASK_ROWS`` training rows: what a task holds doesn't grow with the table, and the model doesn't
    depend on the files that the rows are read from.

    With ``validation`` rows, boosting ends at the first round that lowers their loss by less than
    ``tolerance`` of it, and keeps the trees up to the best; ``rounds`` is the most there may be.
    """
    row = train.agg(
        F.sum("label").alias("y"), F.count("*").alias("n"), *[F.min(F.col(c).cast("double")).alias(c) for c in features], *[F.count_if(F.col(c).isNull()).alias(f"{c}__nulls") for c in features]
    ).first()
    floors = {c: (row[c] if row[c] is not None else 0.0) - 1.0 for c in features}
    how = Prepared(tuple(features), floors, tuple(c for c in features if row[f"{c}__nulls"]), (row["n"] - row["y"]) / max(row["y"], 1))
    rows = train.select(F.col(key).alias("key"), "label", *features, F.lit(False).alias("held_out"))
    if validation is not None:
        rows = rows.unionByName(validation.select(F.col(key).alias("key"), "label", *features, F.lit(True).alias("held_out")))
    assembler = VectorAssembler(inputCols=how.inputs, outputCol="features")
    parts = max(-(-row["n"] // TASK_ROWS), min(8, -(-row["n"] // FEW_ROWS)), 1)
    data = assembler.transform(_labelled(rows, how)).select("key", "label", "w", "held_out", "features").repartition(parts, "key").sortWithinPartitions("key")
    tree = GBTClassifier(labelCol="label", weightCol="w", maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=0.8, seed=42)
    if validation is not None:
        tree = tree.setValidationIndicatorCol("held_out").setParams(validationTol=tolerance)
    return PipelineModel([assembler, tree.fit(data)]), how


def _labelled(df: DataFrame, how: Prepared) -> DataFrame:
    return prepare(df, how).withColumns({"w": F.when(F.col("label") == 1, how.weight).otherwise(1.0), "label": F.col("label").cast("double")})


def losses(model: PipelineModel, how: Prepared, df: DataFrame) -> list[float]:
    """The mean loss of labelled rows after each round."""
    return model.stages[-1].evaluateEachIteration(model.stages[0].transform(_labelled(df, how)))


def score(model: PipelineModel, how: Prepared, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Probability, decision, risk score and level."""
    out = model.transform(prepare(df, how)).withColumn("p", vector_to_array("probability")[1])
    out = out.drop(*how.inputs, "features", "rawPrediction", "probability", "prediction")
    return out.withColumns({"predicted": (F.col("p") >= threshold).cast("int"), "risk": risk_score(F.col("p"))}).withColumn("level", risk_level(F.col("risk")))


def importance(model: PipelineModel, how: Prepared, spark: SparkSession) -> DataFrame:
    total = np.zeros(len(how.features))
    np.add.at(total, how.owners, model.stages[-1].featureImportances.toArray())
    return spark.createDataFrame(list(zip(how.features, total.tolist(), strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


@dataclass(frozen=True)
class Trees:
    """The nodes of each tree as arrays, and the trees' weights; a leaf has feature -1."""

    nodes: list[tuple[np.ndarray, ...]]
    weights: list[float]

    @classmethod
    def of(cls, model: PipelineModel, spark: SparkSession) -> "Trees":
        """From the table of nodes that a saved model has: at most 2^(depth + 1) rows a tree."""
        path = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
        boosted = model.stages[-1]
        boosted.write().save(path)
        n = F.col("nodeData")
        table = spark.read.parquet(f"{path}/data").select("treeID", n["id"].alias("id"), n["prediction"].alias("value"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"), n["split"]["leftCategoriesOrThreshold"][0].alias("threshold"))
        rows = table.where("left >= 0").unionByName(table.where("left < 0").withColumns({"feature": F.lit(-1), "threshold": F.lit(0.0)})).orderBy("treeID", "id").toPandas()
        each = [tuple(g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "value")) for _, g in rows.groupby("treeID")]
        return cls(each, list(boosted.treeWeights))

    @property
    def bias(self) -> float:
        """The log-odds before any split: twice the weighted values of the roots, as the classifier's margin counts."""
        return sum(2 * w * float(t[4][0]) for t, w in zip(self.nodes, self.weights, strict=True))

    def contributions(self, x: np.ndarray, owners: Sequence[int], n: int) -> np.ndarray:
        """What each feature adds to each row's log-odds: on the row's path through each tree, the change
        of the node's value at every split goes to the feature that is split on."""
        out, row, owner = np.zeros((len(x), n)), np.arange(len(x)), np.asarray(owners)
        for (feature, threshold, left, right, value), w in zip(self.nodes, self.weights, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(inner := row[feature[node] >= 0]):
                at = node[inner]
                child = np.where(x[inner, feature[at]] <= threshold[at], left[at], right[at])
                out[inner, owner[feature[at]]] += 2 * w * (value[child] - value[at])
                node[inner] = child
        return out


def contributions(model: PipelineModel, how: Prepared, df: DataFrame, key: str = "event_id") -> DataFrame:
    """``(key, bias, parts)``: what each feature adds to the row's log-odds, in the order of ``how.features``.

    ``bias`` and the parts add up to the log-odds of the row's probability.
    """
    trees = Trees.of(model, df.sparkSession)
    bias, owners, n = trees.bias, how.owners, len(how.features)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch[c].to_numpy(zero_copy_only=False) for c in how.inputs])
            parts = trees.contributions(x, owners, n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1) * n, pa.int32()), pa.array(parts.ravel()))
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(np.full(len(parts), bias)), lists], [key, "bias", "parts"])

    rows = prepare(df, how).select(key, *how.inputs)
    return rows.mapInArrow(add, f"{key} {dict(df.dtypes)[key]}, bias double, parts array<double>")


def attributions(model: PipelineModel, how: Prepared, df: DataFrame, top: int = 6) -> DataFrame:
    """The ``top`` features of each row by what they add to its log-odds, with sign. No shuffle: a row's parts come together."""
    named = F.arrays_zip(F.array(*map(F.lit, how.features)).alias("feature"), F.col("parts").alias("contribution"))
    order = F.transform(named, lambda r: F.struct((-F.abs(r["contribution"])).alias("size"), r["feature"].alias("feature"), r["contribution"].alias("contribution")))
    rows = contributions(model, how, df).select("event_id", F.posexplode(F.slice(F.array_sort(order), 1, top)).alias("at", "r"))
    return rows.select("event_id", (F.col("at") + 1).alias("rank"), "r.feature", "r.contribution")


def global_attributions(model: PipelineModel, how: Prepared, df: DataFrame) -> DataFrame:
    """Mean absolute and mean signed contribution of each feature over all rows."""
    rows = contributions(model, how, df).select(F.posexplode("parts").alias("at", "part"))
    means = rows.groupBy("at").agg(F.avg(F.abs("part")).alias("mean_abs"), F.avg("part").alias("mean"))
    return means.select(F.array(*map(F.lit, how.features))[F.col("at")].alias("feature"), "mean_abs", "mean").orderBy(F.desc("mean_abs"), "feature")


#: Relative changes of the amount that a counterfactual search tries, both ways.
FRACTIONS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 4.0)


def counterfactuals(model: PipelineModel, how: Prepared, df: DataFrame, types: Sequence[str], derive: Callable[[DataFrame], DataFrame], fractions: Sequence[float] = FRACTIONS, threshold: float = 0.5) -> DataFrame:
    """The nearest change that flips each decision: each fraction of the amount off or on it, or another type.

    ``derive`` makes all that depends on amount or type anew, so only rows that could exist are scored, all
    candidates in one pass; each brings its row's own decision along, and only those that flip it are shuffled. Amounts stay at zero or above. The distance is the change of the amount relative
    to it (to 1 below 1), and 1 for another type; of equal ones an amount comes before a type, a decrease
    before an increase, and types in the order given. Rows that nothing flips are left out.
    """
    base = score(model, how, df, threshold).select(*df.columns, F.col("predicted").alias("was"), F.col("p").alias("p_was"))
    change = lambda kind, turn, factor, to: F.struct(F.lit(kind).alias("kind"), F.lit(turn).alias("turn"), F.lit(float(factor)).alias("factor"), F.lit(to).cast("string").alias("to"))
    amounts = [change("amount", i, 1 + sign * f, None) for i, (f, sign) in enumerate((f, s) for f in fractions for s in (-1, 1))]
    others = [change("type", i, 1.0, t) for i, t in enumerate(types)]
    grid = base.withColumns({"amount_was": F.col("amount"), "type_was": F.col("type")}).withColumn("change", F.explode(F.array(*amounts, *others)))
    grid = grid.withColumns({"amount": F.greatest(F.lit(0.0), F.col("amount") * F.col("change.factor")), "type": F.coalesce("change.to", "type")})
    grid = derive(grid.where("amount <> amount_was OR type <> type_was"))
    moved = F.abs(F.col("amount") - F.col("amount_was")) / F.greatest(F.abs("amount_was"), F.lit(1.0))
    distance = F.when(F.col("change.kind") == "type", F.lit(1.0)).otherwise(moved)
    out = score(model, how, grid, threshold).where("predicted <> was")
    best = F.min_by(F.struct("change.kind", "amount", "type", "p", distance.alias("distance")), F.struct(distance, "change.kind", "change.turn"))
    return out.groupBy("event_id", "was", "p_was").agg(best.alias("b")).select("event_id", "was", "p_was", "b.kind", "b.amount", "b.type", "b.p", "b.distance")
