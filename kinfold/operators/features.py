"""Pairwise features of candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.similarity import indel_similarity, jaro_winkler_similarity, set_ratios, subsequence, subset_either_way
from kinfold.operators.blocking import term_frequency

FEATURES = (
    "name_tok_jac", "name_tok_dice", "name_tok_ovr_co", "name_tok_cont", "name_ph_jac", "name_ph_dice", "name_ph_ovr_co",
    "name_exact_norm", "name_exact_core", "name_fuzz_norm", "name_fuzz_core", "name_fuzz_alt", "name_fuzz_raw", "name_jw",
    "name_subseq", "name_len_diff", "name_shorter_in_longer", "name_token_prec", "name_token_rec", "addr_tok_jac",
    "addr_tok_dice", "addr_tok_ovr_co", "addr_exact_norm", "addr_fuzz", "addr_jw", "addr_digit_jac", "addr_digit_eq",
    "addr_digit_sub", "pin_eq", "state_eq", "state_missing", "domain_eq", "dom_any", "a_name_df", "b_name_df", "tok_rarity",
    "country_eq", "b_addr_empty", "a_addr_empty", "core_subset", "ph_subset", "nums_eq", "num_tokens_eq",
)
#: Left out of models by default.
DROPPED = ("country_eq", "dom_any", "name_exact_norm", "a_addr_empty")
_SIDE = ("name_raw", "addr_raw", "country", "name_toks", "addr_toks", "core_toks", "alt_name_toks", "digits", "pin", "state", "domain", "name_ph", "min_df", "core_min_df")


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def set_features(a, b) -> dict[str, Column]:
    """Features of token sets and lists, without user functions; a and b give a column of either side."""
    name, addr, core, dig = (set_ratios(a(c), b(c)) for c in ("name_toks", "addr_toks", "core_toks", "digits"))
    nums = lambda side: F.array_sort(F.filter(side("name_toks"), lambda t: t.rlike("^[0-9]+$")))
    full = lambda r: _flag((r["jac"] >= 0.999) & (r["cont"] >= 0.999))
    eq = _flag((dig["ovr"] >= 0.999) & (dig["jac"] > 0))
    return {
        "name_tok_jac": name["jac"], "name_tok_dice": name["dice"], "name_tok_ovr_co": name["ovr"], "name_tok_cont": name["cont"],
        "name_exact_norm": full(name), "name_exact_core": _flag((core["ovr"] >= 0.999) & (core["cont"] >= 0.999)),
        "name_subseq": _flag(subsequence(a("name_toks"), b("name_toks")) | subsequence(b("name_toks"), a("name_toks"))),
        "name_len_diff": F.abs(F.size(a("name_toks")) - F.size(b("name_toks"))).cast("double"),
        "name_shorter_in_longer": _flag(subset_either_way(a("core_toks"), b("core_toks"))),
        "name_token_prec": name["prec"], "name_token_rec": name["rec"],
        "addr_tok_jac": addr["jac"], "addr_tok_dice": addr["dice"], "addr_tok_ovr_co": addr["ovr"], "addr_exact_norm": full(addr),
        "addr_digit_jac": dig["jac"], "addr_digit_eq": eq, "addr_digit_sub": dig["ovr"], "core_subset": core["ovr"],
        "nums_eq": _flag(nums(a) == nums(b)), "num_tokens_eq": eq,
    }


def flag_features(a, b) -> dict[str, Column]:
    """Agreement and emptiness. pin_eq and domain_eq are also 1 where both sides lack a value."""
    known = (a("state") != "") & (b("state") != "")
    return {
        "pin_eq": _flag(a("pin").eqNullSafe(b("pin"))), "state_eq": _flag((a("state") == b("state")) & (a("state") != "")),
        "state_missing": _flag(~known), "domain_eq": _flag(a("domain") == b("domain")), "dom_any": _flag(a("domain") != ""),
        "country_eq": _flag(a("country") == b("country")),
        "b_addr_empty": _flag(F.size(b("addr_toks")) == 0), "a_addr_empty": _flag(F.size(a("addr_toks")) == 0),
    }


def phonetic_features(a, b) -> dict[str, Column]:
    ph = set_ratios(a("name_ph"), b("name_ph"))
    return {"name_ph_jac": ph["jac"], "name_ph_dice": ph["dice"], "name_ph_ovr_co": ph["ovr"], "ph_subset": ph["ovr"]}


def string_features(a, b) -> dict[str, Column]:
    """Edit similarities, by Arrow functions over the distinct pairs of a batch; all strings of a side are given as
    they are, without the record being shipped."""
    text = lambda side, c: F.array_join(side(c), " ")
    alt = lambda side: F.array_join(F.coalesce(side("alt_name_toks"), side("name_toks")), " ")
    low = lambda side, c: F.lower(side(c))
    return {
        "name_fuzz_norm": indel_similarity(text(a, "name_toks"), text(b, "name_toks")),
        "name_fuzz_core": indel_similarity(text(a, "core_toks"), text(b, "core_toks")),
        "name_fuzz_alt": F.greatest(indel_similarity(text(a, "name_toks"), alt(b)), indel_similarity(alt(a), text(b, "name_toks"))),
        "name_fuzz_raw": indel_similarity(a("name_raw"), b("name_raw")),
        "name_jw": jaro_winkler_similarity(low(a, "name_raw"), low(b, "name_raw")),
        "addr_fuzz": indel_similarity(a("addr_raw"), b("addr_raw")),
        "addr_jw": jaro_winkler_similarity(low(a, "addr_raw"), low(b, "addr_raw")),
    }


def frequency_features(a, b) -> dict[str, Column]:
    """Frequencies of the rarest name word of either side, and of B's rarest core word."""
    df = lambda c: F.log1p(F.coalesce(c, F.lit(0)).cast("double"))
    return {"a_name_df": df(a("min_df")), "b_name_df": df(b("min_df")), "tok_rarity": F.coalesce(b("core_min_df"), F.lit(0)).cast("double")}


def with_frequencies(records: DataFrame) -> DataFrame:
    """records with min_df and core_min_df, made once a record before pairs are."""
    df = term_frequency(records, "name_toks")
    terms = records.select("eid", F.explode(F.array_distinct("name_toks")).alias("term"), F.col("core_toks"))
    low = terms.join(df, "term").groupBy("eid").agg(F.min("df").alias("min_df"), F.min(F.when(F.array_contains("core_toks", F.col("term")), F.col("df"))).alias("core_min_df"))
    return records.join(low, "eid", "left")


def pair_sides(pairs: DataFrame, records: DataFrame, columns: tuple[str, ...] = _SIDE) -> DataFrame:
    """pairs with structs a and b of the records' columns."""
    have = [c for c in columns if c in records.columns]
    side = records.select("eid", F.struct(*have).alias("r"))
    return pairs.join(side.withColumnsRenamed({"eid": "s1_id", "r": "a"}), "s1_id").join(side.withColumnsRenamed({"eid": "s2_id", "r": "b"}), "s2_id")


def features(pairs: DataFrame, records: DataFrame, groups: tuple = (set_features, flag_features, phonetic_features, string_features, frequency_features)) -> DataFrame:
    """pairs with the features of the given groups; all 43 by default (records need with_frequencies() and codes)."""
    if frequency_features in groups and "min_df" not in records.columns:
        records = with_frequencies(records)
    sides = pair_sides(pairs, records)
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    cols: dict[str, Column] = {}
    for g in groups:
        cols |= g(a, b)
    return sides.select(*pairs.columns, *[cols[c].alias(c) for c in FEATURES if c in cols])
