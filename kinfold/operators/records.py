"""Records normalised once, before any pair is made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import text as T
from kinfold.functions.phonetic import metaphones
from kinfold.functions.romanize import romanize


def normalize(records: DataFrame, phonetic: bool = True, roman: bool = True) -> DataFrame:
    """Derived columns for (entity_id, business_name, business_address, country, src).

    If name or address has Indic letters, both are romanised: the primary reading is normalised as the record's own
    view, the alternate one where it differs as a second view. Nulls count as empty.
    """
    r = records.select(F.col("entity_id").alias("eid"), "src", "country", F.coalesce("business_name", F.lit("")).alias("name_raw"), F.coalesce("business_address", F.lit("")).alias("addr_raw"))
    if roman:
        indic = F.col("name_raw").rlike(T.INDIC) | F.col("addr_raw").rlike(T.INDIC)
        r = r.withColumn("n", romanize("name_raw")).withColumn("a", romanize("addr_raw")).withColumn("indic", indic)
        view = lambda side, which, raw: F.when(F.col("indic"), F.col(f"{side}.{which}")).otherwise(F.col(raw))
        r = r.withColumn("name", T.clean(view("n", "primary", "name_raw"))).withColumn("addr", T.clean(view("a", "primary", "addr_raw")))
        r = r.withColumn("alt_name", T.clean(view("n", "alternate", "name_raw"))).withColumn("alt_addr", T.clean(view("a", "alternate", "addr_raw"))).drop("n", "a", "indic")
    else:
        r = r.withColumn("name", T.clean(F.col("name_raw"))).withColumn("addr", T.clean(F.col("addr_raw"))).withColumn("alt_name", F.col("name")).withColumn("alt_addr", F.col("addr"))
    differs = (F.col("alt_name") != F.col("name")) | (F.col("alt_addr") != F.col("addr"))
    r = r.withColumn("name_toks", T.split_words(F.col("name"))).withColumn("addr_toks", T.split_words(F.col("addr"))).withColumn("alt_name_toks", F.when(differs, T.split_words(F.col("alt_name"))))
    r = r.withColumn("core_toks", T.core_words(F.col("name_toks"))).withColumn("alt_core_toks", T.core_words(F.col("alt_name_toks")))
    r = r.withColumn("digits", T.digit_groups(F.col("addr_raw"))).withColumn("pin", T.postal_code(F.col("addr_raw"))).withColumn("state", T.state(F.col("addr_raw"), F.col("addr_toks"))).withColumn("domain", T.domain(F.col("name_raw")))
    if phonetic:
        first = F.when(F.size("addr_toks") > 0, F.slice("addr_toks", 1, 1)).otherwise(F.array().cast("array<string>"))
        r = r.withColumn("name_ph", metaphones("name_toks")).withColumn("core_ph", metaphones("core_toks")).withColumn("alt_core_ph", metaphones("alt_core_toks")).withColumn("addr_ph0", F.get(metaphones(first), 0))
    return r
