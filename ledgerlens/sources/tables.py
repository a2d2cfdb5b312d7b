"""Readers and writers: typed CSV, Parquet, JSON lines, Kafka; create-only and verified writes."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None) -> DataFrame:
    """Typed CSV with a header; a malformed row is an error."""
    out = spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=False)
    return out.select(*columns) if columns else out


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parsed lines, and lines that aren't JSON of the schema."""
    lines = spark.read.text(path)
    parsed = lines.withColumn("r", F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_corrupt"), parsed.where(bad).select("value")


def last_wins(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last record of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def union_logs(sources: Mapping[str, DataFrame], fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """Logs with other field names as one table: the first alias that a source has is taken."""
    out = None
    for name, df in sources.items():
        cols: list[Column] = []
        for field, aliases in fields.items():
            have = [F.col(a) for a in aliases if a in df.columns]
            cols.append((F.coalesce(*have) if have else F.lit(None)).alias(field))
        one = df.select(*cols, F.lit(name).alias("source"))
        out = one if out is None else out.unionByName(one)
    return out


def newest_valid(reports: DataFrame, name: str, body: str, schema: str, ok: Column) -> DataFrame:
    """The last report by name among those that parse and pass ``ok`` (on ``r``)."""
    parsed = reports.withColumn("r", F.from_json(body, schema)).where(F.col("r").isNotNull() & ok)
    return parsed.agg(F.max_by(F.struct(F.col(name).alias("name"), F.col("r")), name).alias("x")).select("x.name", "x.r.*")


def write_new(df: DataFrame, path: str, **options) -> None:
    """Refuse to overwrite."""
    df.write.mode("errorifexists").options(**options).parquet(path)


def write_verified(df: DataFrame, path: str, label: str = "label") -> DataFrame:
    """Write, read back, and compare row count and label sum; a difference is an error."""
    write_new(df, path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    sums = lambda x: tuple(x.agg(F.count("*"), F.sum(label)).first())
    want, got = sums(df), sums(back)
    if want != got:
        raise ValueError(f"read back {got}, wrote {want}")
    return back


def kafka_options(servers: str, topic: str, starting: str = "earliest", per_trigger: int = 1000) -> dict[str, str]:
    """Options of ``readStream.format('kafka')``; the connector comes with the cluster."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "maxOffsetsPerTrigger": str(per_trigger), "failOnDataLoss": "true"}


def read_stream(spark: SparkSession, kind: str, schema: str | None = None, path: str | None = None, **options) -> DataFrame:
    """A stream of files (json, text, parquet) or of Kafka records."""
    reader = spark.readStream.format(kind).options(**options)
    if schema:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def newest(logs: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """The last ``limit`` records by ``order``, newest first; NULLs come last."""
    return logs.orderBy(*[F.desc_nulls_last(c) for c in order]).limit(limit)
