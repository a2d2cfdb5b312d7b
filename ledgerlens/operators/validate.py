"""Validation: first failing rule, redaction, dataset contracts, leak checks."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.profile import unpivot_aggs

LABEL_KEYS = ("label", "isFraud", "is_fraud", "outcome")
REDACTED = "[REDACTED]"


def first_failure(rules: Mapping[str, Column]) -> Column:
    """Name of the first rule that isn't TRUE (NULL counts as failed), NULL if all hold."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()])


def split_by(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected ones with their ``reason``."""
    checked = df.withColumn("reason", first_failure(rules))
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")


NUMERIC = r"^(BIGINT|DOUBLE|DECIMAL.*)$"
#: Members of an event, with the type that each is read as.
MEMBERS = {"event_id": "string", "step": "bigint", "type": "string", "amount": "double", "sender": "string", "dest": "string"}


def parsed(df: DataFrame, raw: str) -> DataFrame:
    """``df`` with ``__is_object``, ``__keys``, and for each member its JSON type and its value.

    The text is parsed once a row. The members come out of a generator, so a filter on them isn't pushed
    below the parse, where every rule would parse the text anew.
    """
    v = F.col("__v")
    member = lambda k, t: (F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")).alias(f"__{k}_kind"), F.try_variant_get(v, f"$.{k}", t).alias(f"__{k}"))
    fields = [F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False)).alias("__is_object"), F.col("__k").alias("__keys"), *[c for k, t in MEMBERS.items() for c in member(k, t)]]
    once = df.withColumns({"__v": F.try_parse_json(F.col(raw)), "__k": F.json_object_keys(F.col(raw))})
    return once.select(*df.columns, F.inline(F.array(F.struct(*fields))))


def event_rules(types: Sequence[str]) -> dict[str, Column]:
    """Rules of a strict JSON event over the columns of ``parsed``, in the order in which a failure is reported."""
    text = lambda k: (F.col(f"__{k}_kind") == "STRING") & (F.length(f"__{k}") > 0)
    return {
        "not_an_object": F.col("__is_object"),
        "label_present": ~F.arrays_overlap("__keys", F.array(*map(F.lit, LABEL_KEYS))),
        "missing_key": F.size(F.array_except(F.array(*map(F.lit, MEMBERS)), "__keys")) == 0,
        "bad_id": text("event_id") & text("sender") & text("dest"),
        "bad_step": (F.col("__step_kind") == "BIGINT") & (F.col("__step") >= 1),
        "unknown_type": text("type") & F.col("__type").isin(*types),
        "bad_amount": F.rlike("__amount_kind", F.lit(NUMERIC)) & (F.col("__amount") >= 0) & (F.col("__amount") < float("inf")),
    }


def validate_events(df: DataFrame, raw: str, types: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Parsed valid events, and rejected rows with the reason and the raw text without labels.

    Works on streams too: both are projections of the input.
    """
    valid, rejected = split_by(parsed(df, raw), event_rules(types))
    return valid.select(*df.columns, *[F.col(f"__{k}").alias(k) for k in MEMBERS]), rejected.select(*df.columns, "reason").withColumn(raw, redact(raw))


def redact(raw: str) -> Column:
    """The text with the values of label members replaced, at any depth, whether it is whole JSON or not.

    Where such a value is an object or an array, or a member's name is written with escapes, so that it
    can't be told where the label ends, the whole text is replaced.
    """
    names = "|".join(LABEL_KEYS)
    plain = F.regexp_replace(raw, rf'"({names})"\s*:\s*("(?:[^"\\]|\\.)*"|[^\s,\[\]{{}}"]+)', f'"$1":"{REDACTED}"')
    nested = F.rlike(plain, F.lit(rf'"({names})"\s*:\s*[\[{{]'))
    cut_off = F.rlike(plain, F.lit(rf'"({names})"\s*:\s*"(?!{REDACTED[:-1].replace("[", chr(92) + "[")})'))
    escaped = F.rlike(F.col(raw), F.lit(r'"[^"]*\\u[^"]*"\s*:'))
    return F.when(nested | cut_off | escaped, REDACTED).otherwise(plain)


def prediction_rules() -> dict[str, Column]:
    p, score = F.col("p"), F.col("risk_score")
    return {
        "bad_id": F.length("transaction_id") > 0,
        "bad_probability": p.between(0, 1) & ~F.isnan(p),
        "bad_score": score.between(0, 100),
        "bad_level": F.col("level").isin("LOW", "MEDIUM", "HIGH"),
        "half_position": F.col("partition").isNull() == F.col("offset").isNull(),
        "bad_time": F.rlike("at", F.lit(r"(Z|[+-]\d\d:?\d\d)$")) & F.try_to_timestamp("at").isNotNull(),
    }


def validate_dataset(df: DataFrame, features: Sequence[str], steps: tuple[int, int] | None = None, audit: Sequence[str] = ()) -> DataFrame:
    """``check, passed, detail``: unique ids, binary labels, finite numbers, steps, no audit columns. One pass."""
    infinite = [F.abs(F.col(c).cast("double")) == float("inf") for c in features]
    any_inf = infinite[0] if infinite else F.lit(False)
    for x in infinite[1:]:
        any_inf = F.coalesce(any_inf, F.lit(False)) | F.coalesce(x, F.lit(False))
    lo, hi = steps or (0, 1 << 62)
    bad = {
        "unique_id": F.count("*") - F.countDistinct("event_id"),
        "label_binary": F.count_if(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))),
        "finite": F.count_if(any_inf),
        "step_range": F.count_if(~F.coalesce(F.col("step").between(lo, hi), F.lit(False))),
        "no_audit_columns": F.lit(len([c for c in audit if c in df.columns])).cast("long"),
    }
    out = unpivot_aggs(df, {k: {"detail": v.cast("long")} for k, v in bad.items()}, name="check")
    return out.select("check", (F.col("detail") == 0).alias("passed"), "detail")


def assert_no_leak(names: Sequence[str], forbidden: Sequence[str] = LABEL_KEYS) -> None:
    found = sorted(set(names) & set(forbidden))
    if found:
        raise ValueError(f"labels or audit columns among the features: {found}")


#: When a column's value is known, relative to the event.
TIMING = {"step": "before", "type": "before", "amount": "before", "sender": "before", "dest": "before", "sender_old": "before", "dest_old": "before", "sender_new": "after", "dest_new": "after", "label": "after"}


def column_timing(df: DataFrame) -> DataFrame:
    """Whether each column may be a feature."""
    rows = [(c, TIMING.get(c, "unclear")) for c in df.columns]
    out = df.sparkSession.createDataFrame(rows, "column_name string, known string")
    return out.withColumn("use", F.when(F.col("known") == "before", "feature").when(F.col("known") == "after", "audit").otherwise("review"))
