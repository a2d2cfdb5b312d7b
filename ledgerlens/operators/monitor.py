"""The monitor's roll-up: recent scored window, overall status, alerts, latest report, dataset gates."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.profile import unpivot_aggs


def recent_scored(log: DataFrame, key: str, order: list[str], version: Column, limit: int) -> DataFrame:
    """The newest ``limit`` records of the active version, the last of each key."""
    rest = [c for c in log.columns if c != key]
    last = log.where(version).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")
    return last.orderBy(*[F.desc(c) for c in order]).limit(limit)


def roll_up(drift: DataFrame, performance: DataFrame, least_recent: int = 30) -> DataFrame:
    """One row of decisions from one-row ``drift (tested, drift, n_recent)`` and ``performance (status)``.

    Too little data is reported as such even where drift fired; alerts are raised all the same.
    """
    one = F.lit(1)
    both = drift.withColumn("k", one).join(performance.withColumn("k", one), "k").drop("k")
    status = F.when((F.col("n_recent") < least_recent) | (F.col("status") == "insufficient_labels"), "insufficient_data").when(F.col("drift"), "drift").when(F.col("status") == "degraded", "degraded").otherwise("healthy")
    alerts = F.array_compact(F.array(F.when(F.col("drift"), "feature_drift"), F.when(F.col("status") == "degraded", "performance")))
    return both.select(status.alias("overall"), F.array_join(alerts, ",").alias("alerts"), (F.size(alerts) > 0).alias("request_retraining"))


def latest(reports: DataFrame, order: str) -> DataFrame:
    """The newest report."""
    return reports.agg(F.max_by(F.struct(*reports.columns), order).alias("r")).select("r.*")


def gates(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """``check, passed, n_bad`` for row conditions that must hold everywhere; one pass."""
    out = unpivot_aggs(df, {k: {"n_bad": F.count_if(~F.coalesce(c, F.lit(False)))} for k, c in checks.items()}, name="check")
    return out.withColumn("passed", F.col("n_bad") == 0)


def recent_vectors(lines: DataFrame, features: Sequence[str], version: str, limit: int, value: str = "value", order: str = "line") -> tuple[DataFrame, DataFrame]:
    """The valid feature vectors among the newest ``limit`` lines of a scored JSON log, and one row about them.

    A line is malformed if it isn't a JSON object, or is of the active ``version`` and lacks an id, a time or a
    feature, or has one that isn't a number or null. Of a transaction the last line counts. The row has what was
    read, what was malformed, the first and last time, and how many vectors came from each origin.
    """
    newest = lines.orderBy(F.desc(order)).limit(limit)
    parsed = newest.select(order, F.try_parse_json(value).alias("v"))
    get = lambda path, kind: F.try_variant_get("v", f"$.{path}", kind)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{path}", "variant")), F.lit("MISSING"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
    flat = parsed.select(
        order, is_object.alias("is_object"), get("transaction_id", "string").alias("transaction_id"), get("model_version", "string").alias("version"), get("processed_at", "string").alias("processed_at"),
        F.coalesce(get("data_origin", "string"), F.lit("unspecified")).alias("origin"), *[get(f"feature_values.{f}", "double").alias(f) for f in features],
        F.forall(F.array(*[kind(f"feature_values.{f}") for f in features]), lambda k: F.rlike(k, F.lit(r"^(BIGINT|DOUBLE|DECIMAL.*|VOID)$"))).alias("numbers"),
    )
    ours = F.col("is_object") & F.coalesce(F.col("version") == version, F.lit(False))
    complete = F.col("numbers") & F.col("transaction_id").isNotNull() & F.col("processed_at").isNotNull()
    marked = flat.withColumns({"ok": ours & complete, "malformed": ~F.col("is_object") | (ours & ~complete)})
    rest = ["processed_at", "origin", *features]
    vectors = marked.where("ok").groupBy("transaction_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("transaction_id", "r.*")
    counts = marked.agg(F.count("*").alias("records_read"), F.count_if("malformed").alias("malformed_records"), F.lit(1).alias("k"))
    origins = vectors.groupBy("origin").agg(F.count("*").alias("n"), F.min("processed_at").alias("a"), F.max("processed_at").alias("b"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("origin", "n"))), lambda o: F.concat_ws("=", o["origin"], o["n"].cast("string"))), ",")  # a few origins
    window = origins.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"), F.min("a").alias("window_start"), F.max("b").alias("window_end"), listed.alias("origins"), F.lit(1).alias("k"))
    return vectors, counts.join(window, "k").drop("k")
