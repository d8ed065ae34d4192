"""Reading and writing catalogs, dictionaries and results."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as X


def normalize_headers(df: DataFrame) -> DataFrame:
    """Headers without outer space, a trailing (*) and inner white space."""
    return df.toDF(*[re.sub(r"\s+", "", re.sub(r"\(\*\)\s*$", "", c.strip())) for c in df.columns])


def resolve_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Logical fields from the first of their spellings that holds a value; none present: null."""
    def field(names: list[str]):
        have = [F.col(f"`{n}`") for n in names if n in df.columns]
        return F.coalesce(*have) if have else F.lit(None).cast("string")

    return df.select(*[field(v).alias(k) for k, v in aliases.items()])


def number_rows(df: DataFrame, name: str = "row_no") -> DataFrame:
    """df with the number of each row, from 1, in the order in which it is read. Partitions are counted first,
    so that no task numbers all. df is written once, as it need not come in the same partitions twice."""
    from ..operators.core import cut

    at = cut(df.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    by = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    before = at.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(by), F.lit(0)).alias("_before"))
    return at.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")


def read_catalog(spark: SparkSession, path: str, fmt: str, required: list[str], name_col: str = "column_name", row_col: str | None = None, policy: str = "skip", **options: str) -> tuple[DataFrame, DataFrame]:
    """Catalog rows with row_no and source_id, and the rows that lack a name (see reject_incomplete_rows).

    Wholly blank rows go. row_col names the column that numbers the rows; without one, they are numbered as
    they are read. A missing required header raises ValueError."""
    df = normalize_headers(spark.read.format(fmt).options(**options).load(path))
    if gone := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing headers: {', '.join(gone)}")
    blank = F.concat_ws("", *[X.trim_all(F.col(f"`{c}`").cast("string")) for c in df.columns]) == ""
    rows = df.withColumn("row_no", F.col(row_col).cast("long")) if row_col else number_rows(df)
    rows = rows.withColumn(name_col, X.upper_trim(F.col(name_col))).filter(~blank)
    rows = rows.withColumn("source_id", F.concat(F.lit("row-"), F.col("row_no")))
    return reject_incomplete_rows(rows, name_col, policy)


def reject_incomplete_rows(df: DataFrame, name_col: str = "column_name", policy: str = "skip") -> tuple[DataFrame, DataFrame]:
    """Rows with a name, and those without. policy: skip leaves it at that; fail and collect raise ValueError,
    naming the first such row, or their number and the first ten."""
    good = F.coalesce(X.trim_all(F.col(name_col)) != "", F.lit(False))
    bad = df.filter(~good)
    if policy != "skip":
        few = [str(r[0]) for r in bad.orderBy("row_no").select("row_no").limit(1 if policy == "fail" else 10).collect()]
        if few:
            raise ValueError(f"row {few[0]} has no {name_col}" if policy == "fail" else f"{bad.count()} rows have no {name_col}: {', '.join(few)}")
    return df.filter(good), bad


def read_rules(spark: SparkSession, path: str | None, optional: bool = False) -> tuple[DataFrame, DataFrame]:
    """Glossary (source, target) and synonyms (group_id, candidate, candidate_order) from a JSON file with
    glossary and synonym_groups. No path, and an optional one that isn't there: empty tables; a given path that
    isn't there raises FileNotFoundError; an unknown key raises ValueError."""
    glossary, synonyms = "source string, target string", "group_id string, candidate string, candidate_order int"
    if path is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            if not optional:
                raise FileNotFoundError(path)
            path = None
    if path is None:
        return spark.createDataFrame([], glossary), spark.createDataFrame([], synonyms)
    text = spark.read.option("wholetext", "true").text(path).select("value")
    if odd := sorted(set(json.loads(text.first()[0]) or {}) - {"glossary", "synonym_groups"}):
        raise ValueError(f"unknown keys: {', '.join(odd)}")
    rules = text.select(F.from_json("value", "glossary array<struct<source:string,target:string,note:string>>, synonym_groups array<struct<id:string,candidates:array<string>>>").alias("r"))
    groups = rules.select(F.explode("r.synonym_groups").alias("g")).select(F.col("g.id").alias("group_id"), F.posexplode("g.candidates").alias("candidate_order", "candidate"))
    return rules.select(F.explode("r.glossary").alias("e")).select("e.source", "e.target"), groups.select("group_id", "candidate", "candidate_order")


def read_dictionary(df: DataFrame) -> DataFrame:
    """Entries in canonical form; blank rows go, a count that is no number or negative is 0."""
    count = F.greatest(F.coalesce(F.expr("try_cast(occurrence_count AS int)"), F.lit(0)), F.lit(0))
    rows = df.select(X.upper_trim(F.col("abbreviation")).alias("abbreviation"), X.upper_trim(F.col("full_name")).alias("full_name"), X.trim_all(F.col("korean_word")).alias("korean_word"), count.alias("occurrence_count"))
    return rows.filter((F.col("abbreviation") != "") & (F.col("full_name") != "") & (F.col("korean_word") != ""))


def write_dictionary(dictionary: DataFrame, failed: DataFrame, path: str) -> None:
    """Two tables under path: the dictionary in the order of its key, and the failed rows."""
    if dictionary.isEmpty() and failed.isEmpty():
        raise ValueError("nothing to write")
    dictionary.orderBy("abbreviation", "full_name", "korean_word").write.mode("overwrite").parquet(f"{path}/dictionary")
    failed.write.mode("overwrite").parquet(f"{path}/failed")


def write_results(source: DataFrame, results: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Source columns unchanged with the result columns; the ids of the two must be the same set, once each."""
    from ..operators.core import id_difference

    if not id_difference(source, results).isEmpty():
        raise ValueError("source and result ids differ")
    source.join(results, "source_id").write.mode("overwrite").format(fmt).save(path)


def review_sheet(results: DataFrame) -> DataFrame:
    """Rows to look at, with what to check, and their reason if they have one."""
    hint = F.concat_ws(" | ", F.when(F.col("status") == "검증실패", "fix errors"), F.when(F.col("confidence") < 85, "low confidence"), F.when(F.col("review_stratum") != "deterministic", F.col("review_stratum")))
    return results.filter(F.col("status").isin("검토필요", "검증실패")).select("source_id", "status", hint.alias("recommended_check"), *[F.coalesce("reason", F.lit("")).alias("reason") for _ in (0,) if "reason" in results.columns])


def write_population(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes and sha256 of each file under path; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def run_metadata(spark: SparkSession, source: str, output: str, stats: DataFrame, options: dict[str, str]) -> DataFrame:
    """One row on a run: its stats (one row), its options, and a digest of its input and of its output, each
    taken over the names and digests of the files, however many they are."""
    from ..operators.digests import set_digest

    def digest(path: str, name: str) -> DataFrame:
        files = file_digests(spark, path)
        whole = set_digest(files, "name", "sha256").select(F.col("sha256").alias(f"{name}_sha256"))
        return whole.crossJoin(files.agg(F.sum("bytes").alias(f"{name}_bytes")))  # one row a side

    set_to = F.create_map(*[F.lit(x) for kv in sorted(options.items()) for x in kv]) if options else F.create_map().cast("map<string,string>")
    return stats.crossJoin(digest(source, "input")).crossJoin(digest(output, "output")).withColumn("options", set_to)  # one row a side


#: What a blind reviewer doesn't see.
WITHHELD = ("confidence", "status", "review_stratum", "review_strata", "validation_codes", "review_reasons", "reason", "evidence", "action")


def blind_sample(sample: DataFrame, dimensions: list[str]) -> DataFrame:
    """sample without what the engine thinks of its rows, with empty columns for ratings, severity and comment."""
    shown = [c for c in sample.columns if c not in WITHHELD]
    return sample.select(*shown, *[F.lit("").alias(c) for c in (*dimensions, "severity", "comment")])


def write_blind_sample(sample: DataFrame, dimensions: list[str], path: str) -> None:
    blind_sample(sample, dimensions).write.mode("overwrite").option("header", "true").csv(path)
