"""Deduplication, joins, set operations and aggregates over catalog rows."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as X


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one on a local master (tests); on a
    cluster, where executors would not see it, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own_folder()
    return found.rstrip("/")


#: All that one driver cuts lies in a folder of this name, within the shared one.
RUN = f"attrium-cut-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again, so that its lineage ends there and it is worked out
    once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{RUN}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Deletes all that this driver has cut; results that are still to be computed from it are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{RUN}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def keyed(df: DataFrame, mode: str) -> DataFrame:
    """Adds the deduplication key. mapping: name and description without white space; context: name, table,
    its description and data type; comment: normalised name and description."""
    keys = {
        "mapping": lambda: [X.upper_trim(F.col("column_name")), X.compact_whitespace(F.col("column_description"))],
        "context": lambda: [F.col(c) for c in ("column_name", "table_name", "table_description", "data_type")],
        "comment": lambda: [X.normalize_column_name(F.col("column_name")), X.normalize_description_key(F.col("column_description"))],
    }[mode]()
    return df.withColumn("dedup_key", F.struct(*[F.coalesce(k, F.lit("")).alias(f"k{i}") for i, k in enumerate(keys)]))


def dedup_sources(df: DataFrame, mode: str) -> DataFrame:
    """source_id, representative (the first row of its key by row_no) and weight (rows of the key).

    Firsts are a partial aggregate and a join, so a key that holds a third of all rows is no hot task."""
    rows = keyed(df, mode).select("source_id", "row_no", "dedup_key")
    firsts = rows.groupBy("dedup_key").agg(F.min_by("source_id", "row_no").alias("representative"), F.count("*").alias("weight"))
    return rows.join(firsts, "dedup_key").select("source_id", "representative", "weight")


def fan_out(results: DataFrame, aliases: DataFrame) -> DataFrame:
    """Results of representatives (source_id) for each alias."""
    return aliases.join(results.withColumnRenamed("source_id", "representative"), "representative").drop("representative", "weight")


def merged(df: DataFrame) -> DataFrame:
    """df for a join by keys that grow with the rows: sorted and merged, not collected by the driver and broadcast, which
    Spark does as long as the files of a table are small, however many rows they hold."""
    return df.hint("merge")


def missing(df: DataFrame, other: DataFrame, key: str = "source_id") -> DataFrame:
    return df.join(merged(other.select(key).distinct()), key, "left_anti")


def replace_rows(df: DataFrame, new: DataFrame, key: str = "source_id") -> DataFrame:
    return missing(df, new, key).unionByName(new)


def one_row(df: DataFrame, key: str = "source_id") -> DataFrame:
    """One row of each key: of several the first in the order of their JSON, so that it's always the same."""
    row = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")


def union_issues(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def id_difference(a: DataFrame, b: DataFrame, key: str = "source_id") -> DataFrame:
    """key, n_left, n_right of keys that the two hold a different number of times."""
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = count(a, "n_left").join(count(b, "n_right"), key, "full").fillna(0, ["n_left", "n_right"])
    return both.filter("n_left != n_right")


def required_minus_present(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Values of key that are required and not present, once each."""
    return required.select(key).subtract(present.select(key))


def sort_output(df: DataFrame, key: str = "source_id") -> DataFrame:
    """df in the order of the number at the end of its ids; ids without one come first, in their own order."""
    return df.orderBy(F.expr(f"try_cast(regexp_extract({key}, '([0-9]+)$', 1) AS bigint)"), key)


def result_stats(results: DataFrame, keys: list[str]) -> DataFrame:
    """Rows for each combination of keys, for each key alone and in all (null: over all of that key)."""
    return results.cube(*keys).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def consistency(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Keys with more than one distinct value: n_values and n_rows. Distinct pairs are counted first."""
    pairs = df.select(*keys, value.alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    return pairs.groupBy(*keys).agg(F.count("*").alias("n_values"), F.sum("_n").alias("n_rows")).filter("n_values > 1")


def batch_rows(df: DataFrame, n: int, buckets: int, by: Column | None = None) -> DataFrame:
    """Adds batch: at most n rows each. Rows are numbered within buckets, so no task numbers all: hashes of the id, or
    what `by` gives."""
    bucket = (F.pmod(F.xxhash64("source_id"), F.lit(buckets)) if by is None else F.pmod(by, F.lit(buckets))).alias("_b")
    rows = df.select("*", bucket)
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("row_no", "source_id"))
    return rows.withColumn("batch", F.concat_ws("-", "_b", F.floor((rank - 1) / n))).drop("_b")


def issue(df: DataFrame, code: str, severity: str = "error", details: Column | None = None) -> DataFrame:
    return df.select("source_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), (details if details is not None else F.lit(None)).cast("string").alias("details"))


def issue_stats(issues: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Errors, warnings and affected sources; with results also covered sources and rows that repeat another."""
    out = issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_distinct("source_id").alias("affected"))
    if results is None:
        return out
    each = results.groupBy(*results.columns).agg(F.count("*").alias("n"))
    return out.crossJoin(each.agg(F.count_distinct("source_id").alias("covered"), F.coalesce(F.sum("n") - F.count("*"), F.lit(0)).alias("duplicates")))  # one row a side


def issue_code_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code", "severity").agg(F.count("*").alias("n"))


def catalog_profile(df: DataFrame) -> DataFrame:
    """Rows, distinct names, descriptions and pairs, duplicates, and rows for each risk code."""
    rows = df.select("column_name", "column_description", X.classify_risk(F.col("column_description"))["codes"].alias("codes"))
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("column_name").alias("names"),
        F.count_distinct("column_description").alias("descriptions"),
        F.count_distinct("column_name", "column_description").alias("pairs"),
        *[F.count_if(F.array_contains("codes", r)).alias(r) for r in X.RISKS],
    )


def several_descriptions(df: DataFrame) -> DataFrame:
    """column_name, n_values and n_rows of names that have more than one description."""
    return consistency(df, ["column_name"], F.col("column_description"))


def comment_profile(df: DataFrame, suffixes: tuple[str, ...] = ("코드", "여부", "번호", "일자", "회차", "일시")) -> DataFrame:
    """One row of figures on descriptions, and the number of names with several (several_descriptions has which)."""
    c = F.col("column_description")
    figures = df.agg(
        F.count_if(F.rlike(c, F.lit("[A-Za-z]"))).alias("letters"),
        F.count_if(F.rlike(c, F.lit("[0-9]"))).alias("digits"),
        F.count_if(F.contains(c, F.lit("/"))).alias("slashes"),
        F.percentile(F.length(c), F.lit(0.5)).alias("median_length"),
        F.percentile(F.length(c), F.lit(0.9)).alias("p90_length"),
        F.max(F.length(c)).alias("max_length"),
        *[F.count_if(F.endswith(c, F.lit(s))).alias(f"suffix_{i}") for i, s in enumerate(suffixes)],
    )
    return figures.crossJoin(several_descriptions(df).agg(F.count("*").alias("several_descriptions")))  # one row a side


def token_rules_template(df: DataFrame, rules: DataFrame, examples: int = 3) -> DataFrame:
    """Unknown English tokens with their rows and first distinct descriptions, most frequent first."""
    tokens = df.select("row_no", "column_description", F.explode(F.array_distinct(X.invalid_english_tokens(F.col("column_description")))).alias("token"))
    tokens = tokens.join(rules.select(F.col("source").alias("token")), "token", "left_anti")
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    firsts = tokens.groupBy("token", "column_description").agg(F.min("row_no").alias("first"))
    few = firsts.withColumn("k", F.row_number().over(Window.partitionBy("token").orderBy("first", "column_description"))).filter(F.col("k") <= examples)
    lists = few.groupBy("token").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "column_description"))), lambda x: x["column_description"]), " | ").alias("examples"))
    return counts.join(lists, "token")


def stage_durations(log: DataFrame) -> DataFrame:
    """log: job, stage, ts. Seconds from each entry to the job's next, by job and stage."""
    ahead = F.lead("ts").over(Window.partitionBy("job").orderBy("ts", "stage"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    spans = log.withColumn("s", F.coalesce(micros(ahead) - micros(F.col("ts")), F.lit(0)))
    return spans.groupBy("job", "stage").agg((F.sum("s") / 1e6).alias("seconds"), F.count("*").alias("entries"))


def job_durations(log: DataFrame) -> DataFrame:
    """Of each job the seconds from its first entry to its last, which all its stages sum up to, its entries and its
    different stages."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    per = log.groupBy("job", "stage").agg(F.count("*").alias("entries"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return per.groupBy("job").agg(((micros(F.max("last")) - micros(F.min("first"))) / 1e6).alias("seconds"), F.sum("entries").alias("entries"), F.count("*").alias("stages"))
