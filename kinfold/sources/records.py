"""Sources and sinks of record linkage, and adapters that make records of other tables."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RECORDS = "entity_id string, business_name string, business_address string, country string"
GOLD = "source1_entity_id string, matched_entity_ids string"
RESULT_COLUMNS = ("source1_entity_id", "matched_entity_ids")
CANDIDATE_COLUMNS = ("source1_entity_id", "candidate_entity_ids")


def read_tsv(spark: SparkSession, path: str | list[str], schema: str = RECORDS, limit: int | None = None) -> DataFrame:
    """Tab-separated UTF-8 with a header and an explicit schema; columns are found by name. limit takes first rows."""
    names = [x.split()[0] for x in schema.split(",")]
    df = spark.read.options(sep="\t", header=True, quote='"', escape='"', multiLine=False, enforceSchema=False, emptyValue="", nullValue="\u0000").csv(path)
    df = df.select(*names)
    return df if limit is None else df.limit(limit)


def stream_tsv(spark: SparkSession, path: str, schema: str = RECORDS) -> DataFrame:
    """The same files as an unbounded source: new ones are picked up as they arrive."""
    return spark.readStream.schema(schema).options(sep="\t", header=True, quote='"', escape='"').csv(path)


def source_of(eid: Column) -> Column:
    """1, 2 or 3 by the id's prefix; null for another."""
    return F.when(eid.startswith("S1-"), 1).when(eid.startswith("S2-"), 2).when(eid.startswith("S3-"), 3)


def union_sources(*sources: DataFrame) -> DataFrame:
    """One relation of several record sets, each with its source number."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.withColumn("src", source_of(F.col("entity_id")))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return explode_gold(read_tsv(spark, path, GOLD))


def explode_gold(gold: DataFrame) -> DataFrame:
    """(s1_id, s2_id) for each id of the comma-joined lists; empty lists give nothing."""
    ids = F.explode(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","))
    return gold.select(F.col("source1_entity_id").alias("s1_id"), ids.alias("s2_id")).where("s2_id <> ''")


def known_pairs(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs both of whose ids have a record."""
    ids = records.select("eid")
    return pairs.join(ids.withColumnRenamed("eid", "s1_id"), "s1_id", "left_semi").join(ids.withColumnRenamed("eid", "s2_id"), "s2_id", "left_semi")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-blank first fields."""
    return read_tsv(spark, path, "entity_id string").where("trim(entity_id) <> ''").distinct()


def subset(records: DataFrame, keep: DataFrame, key: str = "eid") -> DataFrame:
    return records.join(keep.select(key).distinct(), key, "left_semi")


def every_kth(df: DataFrame, k: int, order: str, path: str | None = None) -> DataFrame:
    """Rows 1, k + 1, 2k + 1, ... in order of a column, nulls last. A sampling operator: positions come from counts of partitions of
    a range-partitioned sort, so no single task sees all rows. The sorted rows are kept, at path (a new one) or else on the
    executors: made twice, they would have other ranges, as Spark draws those from samples."""
    by = F.col(order).asc_nulls_last()
    ordered = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    ordered = write_stage(ordered, path) if path else ordered.localCheckpoint()
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_low"))
    rows = sorted(sizes.collect(), key=lambda r: r["_part"])  # one row a partition
    begin, start = 0, {}
    for r in rows:
        start[r["_part"]] = begin - r["_low"]
        begin += r["_n"]
    if not start:
        return df.limit(0)
    shift = F.element_at(F.create_map(*[F.lit(x) for kv in start.items() for x in kv]), F.col("_part"))
    return ordered.where((F.col("_row") + shift) % k == 0).drop("_part", "_row")


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, those with the smallest hash of the key, by a hash that every engine has; the same ones however
    the data are partitioned. A sampling operator."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


# ---------------------------------------------------------------- sinks


def id_lists(s1: DataFrame, pairs: DataFrame, columns: tuple[str, str] = RESULT_COLUMNS) -> DataFrame:
    """One row for every S1 id with its partners' ids, sorted and comma-joined; the empty string for none."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("s2_id")), ",").alias("ids"))
    return s1.select(F.col("eid").alias("s1_id")).join(lists, "s1_id", "left").select(F.col("s1_id").alias(columns[0]), F.coalesce("ids", F.lit("")).alias(columns[1]))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(sep="\t", header=True, quote='"', escape='"', emptyValue="").csv(path)


def write_stage(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """A stage's output as Parquet, read back; what follows doesn't recompute it."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.parquet(path)


# ---------------------------------------------------------------- adapters


_WORD = re.compile("[a-z0-9]+|&")


@F.pandas_udf(StructType([StructField(c, StringType()) for c in ("name", "address", "digest")]))
def _ends(text: pd.Series) -> pd.DataFrame:
    """The first six and the last six words of each cleaned text, and a digest of all of them, from one pass over the text."""
    from kinfold.functions.text import fold_text

    words = [_WORD.findall(fold_text(t or "").lower()) for t in text]
    return pd.DataFrame({"name": [" ".join(w[:6]) for w in words], "address": [" ".join(w[-6:]) for w in words], "digest": [hashlib.md5(" ".join(w).encode()).hexdigest() for w in words]})


def document_id(doc_id: Column) -> Column:
    return F.concat(F.lit("S"), (doc_id % 3 + 1).cast("string"), F.lit("-"), doc_id.cast("string"))


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents as records: ids by doc_id modulo 3, the first six words as name, the last six as address; and a digest of
    all words, which tells equal cleaned texts."""
    d = docs.select("doc_id", F.col("lang").alias("country"), _ends("text").alias("e"))
    return d.select(document_id(F.col("doc_id")).alias("entity_id"), F.col("e.name").alias("business_name"), F.col("e.address").alias("business_address"), "country", (F.col("doc_id") % 3 + 1).cast("int").alias("src"), "e.digest")


def from_parts(part: DataFrame) -> DataFrame:
    """Parts as records of one country with state and postal code: many share a name, so groups are oversized."""
    src = (F.col("p_partkey") % 3 + 1).cast("int")
    return part.select(
        F.concat(F.lit("S"), src.cast("string"), F.lit("-"), F.col("p_partkey").cast("string")).alias("eid"),
        src.alias("src"), F.lit("XX").alias("country"), F.split(F.lower("p_name"), " ").alias("core_toks"),
        F.col("p_type").alias("state"), F.col("p_size").cast("long").alias("pin"),
    )
