"""Prediction registry and delayed labels as folds over append-only logs."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold_predictions(log: DataFrame, order: Sequence[str], key: str = "transaction_id", payload: str = "payload") -> DataFrame:
    """Disposition of each record: the first of a key is registered, an equal later one is a
    duplicate, a different payload is a conflict, recorded once for each distinct payload.

    The first record of a key comes from an aggregate joined back, not from a window, so a key of
    any number of records is split like any other skewed join.
    """
    first = log.groupBy(key).agg(F.min_by(F.struct(payload, *order), F.struct(*order)).alias("f"))
    seen = log.groupBy(key, payload).agg(F.min(F.struct(*order)).alias("o"))
    at = F.struct(*order)
    out = log.join(first, key).join(seen.withColumnsRenamed({payload: "__p"}), [log[key] == seen[key], log[payload].eqNullSafe(F.col("__p"))]).drop(seen[key])
    is_first = at == F.struct(*[F.col(f"f.{c}") for c in order])
    same = F.col(payload).eqNullSafe(F.col(f"f.{payload}"))
    state = F.when(is_first, "registered").when(same, "duplicate").when(at == F.col("o"), "conflict").otherwise("conflict_repeat")
    return out.withColumn("disposition", state).drop("f", "o", "__p")


def fold_labels(submissions: DataFrame, predictions: DataFrame, trusted: Sequence[str], order: str = "turn", key: str = "transaction_id") -> DataFrame:
    """Disposition of each label submission, in order: unknown source, repeated submission_id
    (replay or conflict), then first accepted label of a transaction and what later ones are to it;
    an accepted label without a prediction yet is pending."""
    by_id = W.partitionBy(key, "submission_id").orderBy(order)
    s = submissions.withColumns({"__n": F.row_number().over(by_id), "__first": F.first("outcome").over(by_id)})
    gate = F.when(~F.col("source_type").isin(*trusted), "rejected").when(F.col("__n") > 1, F.when(F.col("outcome") == F.col("__first"), "replay").otherwise("submission_conflict"))
    s = s.withColumn("__gate", gate)
    open_ = F.when(F.col("__gate").isNull(), F.col(order))
    s = s.withColumn("__at", F.min(open_).over(W.partitionBy(key)))
    s = s.withColumn("__label", F.max(F.when(F.col(order) == F.col("__at"), F.col("outcome"))).over(W.partitionBy(key)))
    known = predictions.select(F.col(key), F.lit(True).alias("__known")).distinct()
    s = s.join(known, key, "left")
    state = F.coalesce(
        F.col("__gate"),
        F.when(F.col(order) == F.col("__at"), F.when(F.col("__known"), "accepted").otherwise("pending_prediction")),
        F.when(F.col("outcome") == F.col("__label"), "duplicate_identical").otherwise("conflict"),
    )
    return s.withColumn("disposition", state).drop("__n", "__first", "__gate", "__at", "__label", "__known")


def label_state(labels: DataFrame, predictions: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Full outer join of facts: a pending label resolves when its prediction arrives, nothing is updated."""
    p = predictions.select(key, F.lit(1).alias("__p"))
    out = labels.join(p, key, "full")
    state = F.when(F.col("label").isNull(), "unlabelled").when(F.col("__p").isNull(), "pending_prediction").otherwise("resolved")
    return out.withColumn("state", state).drop("__p")


def reasons(rules: Mapping[str, Column]) -> Column:
    """Names of all conditions that hold, as an array."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in rules.items()]))


def eligible_labels(facts: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Facts without any exclusion, and how often each exclusion holds."""
    marked = facts.withColumn("excluded", reasons(rules))
    counts = marked.select(F.explode("excluded").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return marked.where(F.size("excluded") == 0).drop("excluded"), counts


def retraining_set(old: DataFrame, recent: DataFrame, gap: tuple[int, int], audit: Sequence[str] = ()) -> DataFrame:
    """Old window and recent labelled rows without audit columns; rows in the gap are left out."""
    both = old.withColumn("source", F.lit("old")).unionByName(recent.withColumn("source", F.lit("recent")), allowMissingColumns=True)
    return both.where(~F.col("step").between(*gap) & F.col("label").isNotNull()).drop(*audit)


def eligibility(summary: DataFrame, least_labels: int = 100, least_positives: int = 10) -> DataFrame:
    """ELIGIBLE, BLOCKED or NOT_REQUIRED with reasons, from a one-row summary
    ``drift, n_labels, n_positives, in_gap``."""
    why = reasons({"too_few_labels": F.col("n_labels") < least_labels, "too_few_positives": F.col("n_positives") < least_positives, "rows_in_gap": F.col("in_gap") > 0})
    out = summary.withColumn("__why", why)
    decision = F.when(~F.col("drift"), "NOT_REQUIRED").when(F.size("__why") > 0, "BLOCKED").otherwise("ELIGIBLE")
    return out.withColumns({"decision": decision, "reasons": F.array_join("__why", ",")}).drop("__why")


def label_checks(joined: DataFrame, key: str = "transaction_id", label: str = "label") -> DataFrame:
    """``check, n_bad, passed`` for labels joined to predictions: values, one row and one label a transaction, all matched."""
    y = F.col(label)
    by = joined.groupBy(key).agg(F.count("*").alias("n"), F.count_if(y.isNull()).alias("missing"), F.count_if(y.isNotNull() & ~y.isin(0, 1)).alias("odd"), F.min(y).alias("lo"), F.max(y).alias("hi"))
    bad = {
        "labels_are_0_or_1": F.coalesce(F.sum("odd"), F.lit(0)),
        "one_row_a_transaction": F.coalesce(F.sum(F.col("n") - 1), F.lit(0)),
        "one_label_a_transaction": F.count_if(F.col("lo") != F.col("hi")),
        "every_transaction_matched": F.coalesce(F.sum("missing"), F.lit(0)),
    }
    row = by.agg(*[v.cast("long").alias(k) for k, v in bad.items()])
    out = row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("n_bad")) for k in bad])).alias("r")).select("r.*")
    present = joined.sparkSession.createDataFrame([("label_column_present", int(label not in joined.columns))], "check string, n_bad long")
    return out.unionByName(present).withColumn("passed", F.col("n_bad") == 0)


def trusted_facts(labels: DataFrame, predictions: DataFrame, vectors: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Everything that decides whether a submitted label may be trained on, one row a submission.

    ``labels`` is what ``fold_labels`` returns; ``predictions`` has ``key, prediction, version, origin, step``, with
    repeats where a transaction was predicted twice; ``vectors`` has ``key`` and ``valid``. Each side is reduced to a
    row a transaction before the join, by aggregates that combine where rows are read.
    """
    said = labels.groupBy(key).agg(F.count_if(F.col("disposition").isin("conflict", "submission_conflict")).alias("n_conflicts"))
    made = predictions.groupBy(key).agg(F.count("*").alias("n_predictions"), (F.min("prediction") != F.max("prediction")).alias("prediction_conflict"), F.max("version").alias("version"), F.min("origin").alias("origin"), F.max("step").alias("step"))
    known = vectors.groupBy(key).agg(F.count("*").alias("n_vectors"), F.bool_and("valid").alias("vector_valid"))
    return labels.join(said, key).join(made, key, "left").join(known, key, "left").fillna(0, ["n_predictions", "n_vectors"])


def trust_rules(trusted: Sequence[str], synthetic: str, version: int, boundary: int) -> dict[str, Column]:
    """Why a label isn't trained on, each over a row of ``trusted_facts``; a label may have several reasons."""
    has = F.col("n_predictions") > 0
    return {
        "synthetic_label": F.col("source_type") == synthetic,
        "untrusted_or_unauthorized": ~F.coalesce(F.col("source_type").isin(*trusted), F.lit(False)),
        "pending_or_rejected": F.col("disposition").isin("pending_prediction", "rejected"),
        "unmatched_prediction": ~has,
        "synthetic_prediction": F.startswith(F.lower("origin"), F.lit("synthetic")),
        "other_version": has & (F.col("version") != version),
        "label_conflict": F.col("n_conflicts") > 0,
        "prediction_conflict": F.col("prediction_conflict"),
        "submission_not_accepted": F.col("disposition") != "accepted",
        "missing_or_duplicate_feature_vector": F.col("n_vectors") != 1,
        "invalid_feature_vector": (F.col("n_vectors") > 0) & ~F.col("vector_valid"),
        "heldout_boundary_violation": F.col("step") <= boundary,
    }


def trust_breakdown(facts: DataFrame, rules: Mapping[str, Column], by: Sequence[str]) -> DataFrame:
    """Labels by source and state: how many, how many are eligible, and of them positive."""
    marked = facts.withColumn("__why", reasons(rules))
    ok = F.size("__why") == 0
    return marked.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(ok).alias("eligible"), F.count_if(ok & (F.col("outcome") == 1)).alias("eligible_positives"))
