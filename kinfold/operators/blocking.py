"""Candidate pairs by families of size-capped blocking keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The most S2 and S3 records that a key's group may have, by key family and preset.
CAPS = {
    "current": {0: 20, 1: 30, 2: 15, 3: 30, 4: 30, 5: 60, 6: 30, 7: 30, 8: 20, 9: 30, 10: 30, 11: 30, 12: 30},
    "tight": {0: 10, 1: 15, 2: 8, 3: 15, 4: 15, 5: 30, 6: 15, 7: 15, 8: 10, 9: 15, 10: 15, 11: 15, 12: 15},
    "loose": {0: 40, 1: 60, 2: 30, 3: 60, 4: 60, 5: 120, 6: 60, 7: 60, 8: 40, 9: 60, 10: 60, 11: 60, 12: 60},
}
DEFAULT_CAP, MAX_PRODUCT, MAX_CORROBORATED = 60, 250_000, 40_000_000
CORROBORATED = (0, 8)
SEP = "|"


def _joined(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.array_join(tokens, SEP))


def term_frequency(records: DataFrame, column: str = "name_toks") -> DataFrame:
    """(term, df): occurrences over all sources."""
    return records.select(F.explode(column).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def rarest(records: DataFrame, column: str, frequency: DataFrame, n: int, by_position: bool) -> DataFrame:
    """(eid, rare): each record's n distinct terms of lowest frequency; ties by first place or by the term itself. Terms of a record
    are few, so a sorted list in its group is all it takes."""
    terms = records.select("eid", F.posexplode(F.array_distinct(column)).alias("pos", "term"))
    tie = F.col("pos") if by_position else F.lit(0)
    ranked = terms.join(frequency, "term").groupBy("eid").agg(F.array_sort(F.collect_list(F.struct("df", tie.alias("tie"), "term"))).alias("r"))
    return ranked.select("eid", F.transform(F.slice("r", 1, n), lambda x: x["term"]).alias("rare"))


def key_columns(records: DataFrame, families: tuple[int, ...] | None = None) -> dict[int, Column]:
    """The key of each family that needs one record only; null for no key."""
    core, ph, digits = F.col("core_toks"), F.col("core_ph"), F.col("digits")
    have = set(records.columns)
    some = lambda c: F.when(c.isNotNull() & (c != ""), c)
    out: dict[int, Column] = {0: _joined(F.array_sort(core))}
    out[2] = F.col("pin").cast("string") if "pin" in have else F.lit(None)
    if "domain" in have:
        out[5] = some(F.col("domain"))
    if "alt_core_toks" in have:
        out[8] = F.coalesce(_joined(F.array_sort("alt_core_toks")), out[0])
    if "core_ph" in have:
        rest = F.array_join(F.array_sort(F.slice(ph, 2, 10_000)), SEP)
        out[1] = F.when(F.size(ph) > 0, F.concat_ws(SEP, F.get(ph, 0), rest))
        out[3] = F.when((F.size(digits) > 0) & F.col("addr_ph0").isNotNull(), F.concat_ws(SEP, F.get(digits, 0).cast("string"), F.col("addr_ph0")))
        out[4] = _joined(F.array_sort(F.array_distinct(ph)))
        out[6] = F.when(F.size(ph) > 1, F.concat_ws(SEP, F.get(ph, 0), F.element_at(ph, -1)))
        word = lambda k: F.coalesce(F.get("addr_toks", k), F.lit("-"))
        out[7] = F.when(F.size(ph) > 2, F.concat_ws(SEP, F.get(ph, 0), F.get(ph, 1), F.get(ph, 2), word(0), word(1)))
        out[9] = F.coalesce(_joined(F.array_sort(F.array_distinct("alt_core_ph"))), out[4])
    return {k: v for k, v in out.items() if families is None or k in families}


def blocking_keys(records: DataFrame, families: tuple[int, ...] | None = None) -> DataFrame:
    """(key_id, country, key, eid, src) in long form; no row where a record has no key.

    0 core words, 1 first code and the others, 2 postal code, 3 first number and first address code, 4 set of codes,
    5 domain, 6 first and last code, 7 three codes and two address words, 8 and 9 are 0 and 4 of the second view, 10 two rarest
    codes, 11 rarest code and first number, 12 two rarest core words.
    """
    wanted = tuple(range(13)) if families is None else families
    cols = key_columns(records, wanted)
    base = ["country", "eid", "src"]
    out = None
    if cols:
        keys = F.array(*[F.struct(F.lit(k).alias("key_id"), v.alias("key")) for k, v in sorted(cols.items())])
        out = records.select(*base, F.inline(F.filter(keys, lambda x: x["key"].isNotNull())))
    if {10, 11} & set(wanted) and "core_ph" in records.columns:
        rare = rarest(records, "core_ph", term_frequency(records, "name_ph"), 2, True)
        r = records.select(*base, "digits").join(rare, "eid")
        ten = F.struct(F.lit(10).alias("key_id"), F.when(F.size("rare") > 1, _joined(F.array_sort("rare"))).alias("key"))
        eleven = F.struct(F.lit(11).alias("key_id"), F.when(F.size("digits") > 0, F.concat_ws(SEP, F.get("rare", 0), F.get("digits", 0).cast("string"))).alias("key"))
        both = F.array(*[x for k, x in ((10, ten), (11, eleven)) if k in wanted])
        more = r.select(*base, F.inline(F.filter(both, lambda x: x["key"].isNotNull())))
        out = more if out is None else out.unionByName(more)
    if 12 in wanted:
        rare = rarest(records, "core_toks", term_frequency(records, "name_toks" if "name_toks" in records.columns else "core_toks"), 2, False)
        more = records.select(*base).join(rare.where(F.size("rare") > 1), "eid").select(*base, F.lit(12).alias("key_id"), _joined(F.array_sort("rare")).alias("key"))
        out = more if out is None else out.unionByName(more)
    return out.select("key_id", "country", "key", "eid", "src")


def _cap(caps: dict[int, int]) -> Column:
    return F.coalesce(F.element_at(F.expr("map(" + ", ".join(f"{k}, {v}" for k, v in caps.items()) + ")"), F.col("key_id")), F.lit(DEFAULT_CAP))


GROUP = ["key_id", "country", "key"]


def group_sizes(keys: DataFrame) -> DataFrame:
    """Sizes of both sides of each group that has both."""
    return keys.groupBy(*GROUP).agg(F.count_if(F.expr("src = 1")).alias("n1"), F.count_if(F.expr("src > 1")).alias("n2")).where("n1 > 0 and n2 > 0")


def _sides(keys: DataFrame, groups: DataFrame, *extra: str) -> tuple[DataFrame, DataFrame]:
    # sizes come first: rows of groups that are too large never meet
    kept = keys.join(groups.select(*GROUP), GROUP)
    one = kept.where("src = 1").select(*GROUP, F.col("eid").alias("s1_id"), *extra)
    two = kept.where("src > 1").select(*GROUP, F.col("eid").alias("s2_id"), *extra)
    return one, two


def capped_pairs(keys: DataFrame, caps: dict[int, int] = CAPS["current"], max_product: int = MAX_PRODUCT) -> DataFrame:
    """(key_id, s1_id, s2_id) of all groups within their caps. The caps are the operator: a group over its cap gives no pair."""
    ok = group_sizes(keys).where((F.col("n2") <= _cap(caps)) & (F.col("n1") * F.col("n2") <= max_product))
    one, two = _sides(keys, ok)
    return one.join(two, GROUP).select("key_id", "s1_id", "s2_id")


def corroborated_pairs(keys: DataFrame, records: DataFrame, caps: dict[int, int] = CAPS["current"], max_product: int = MAX_PRODUCT, limit: int = MAX_CORROBORATED) -> DataFrame:
    """(key_id, s1_id, s2_id) of exact-name groups over their caps, where postal codes or states are known and equal: two
    equi-joins instead of a filter over the group's whole product."""
    over = group_sizes(keys.where(F.col("key_id").isin(*CORROBORATED))).where(((F.col("n2") > _cap(caps)) | (F.col("n1") * F.col("n2") > max_product)) & (F.col("n1") * F.col("n2") <= limit))
    full = keys.where(F.col("key_id").isin(*CORROBORATED)).join(records.select("eid", "pin", "state"), "eid")
    parts = []
    for c, known in (("pin", F.col("pin").isNotNull()), ("state", F.col("state") != "")):
        one, two = _sides(full.where(known), over, c)
        parts.append(one.join(two, [*GROUP, c]).select("key_id", "s1_id", "s2_id"))
    return parts[0].unionByName(parts[1]).distinct()


def candidate_pairs(records: DataFrame, families: tuple[int, ...] | None = None, caps: dict[int, int] = CAPS["current"], corroborate: bool = True) -> DataFrame:
    """Distinct (s1_id, s2_id) over all key families."""
    keys = blocking_keys(records, families)
    pairs = capped_pairs(keys, caps)
    if corroborate:
        pairs = pairs.unionByName(corroborated_pairs(keys, records, caps))
    return pairs.select("s1_id", "s2_id").distinct()


def preset_statistics(keys: DataFrame) -> DataFrame:
    """(preset, groups, pairs) before dedup for every cap preset in one pass over the group sizes."""
    rows = F.array(*[F.struct(F.lit(p).alias("preset"), _cap(c).alias("cap")) for p, c in CAPS.items()])
    sized = group_sizes(keys).select("*", F.inline(rows)).where((F.col("n2") <= F.col("cap")) & (F.col("n1") * F.col("n2") <= MAX_PRODUCT))
    return sized.groupBy("preset").agg(F.count("*").alias("n_groups"), F.sum(F.col("n1") * F.col("n2")).alias("n_pairs"))


def key_hits(gold: DataFrame, keys: DataFrame) -> DataFrame:
    """(s1_id, s2_id, key_id) where a gold pair's records have an equal key, caps aside: joins on ids, not on keys."""
    one = keys.select(F.col("eid").alias("s1_id"), "key_id", "country", "key")
    two = keys.select(F.col("eid").alias("s2_id"), "key_id", "country", "key")
    return gold.join(one, "s1_id").join(two, ["s2_id", "key_id", "country", "key"]).select("s1_id", "s2_id", "key_id").distinct()
