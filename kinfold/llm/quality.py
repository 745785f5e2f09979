"""Quality rules: a threshold table compiled into Spark expressions, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import table

#: What separates words, as a regular expression class.
GAP = r"[\x20\x09-\x0D]"
WINDOW = 8
#: Frequent function words of the four languages; a text of sentences has several of them.
STOP_WORDS = (
    "the be to of and that have with in is it for on as was at by this from a "
    "le la les de des du et un une que qui dans en pour est sur avec par "
    "der die das und zu den von mit ist im ein eine nicht auf sich "
    "el los las que y en un una por con para se del no"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= expression <= high (None: no bound)."""

    name: str
    expression: str
    low: float | None = None
    high: float | None = None


#: The shipped thresholds. Ratios are written over integer counts, and SQL engines agree on them.
RULES = (
    Rule("length", "n_words", 20, 100_000),
    Rule("repeated_windows", "n_repeat_words / n_words", None, 0.30),
    Rule("mean_word_length", "word_chars / n_words", 2.5, 14),
    Rule("symbols", "n_symbols / n_words", None, 0.10),
    Rule("stop_words", "n_stop_words", 2, None),
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.50),
    Rule("bullet_lines", "n_bullet_lines / n_lines", None, 0.90),
    Rule("ellipsis_lines", "n_ellipsis_lines / n_lines", None, 0.30),
)
BASE = ("length", "repeated_windows")


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression: every rule holds. Texts without words or lines have counts of 0 and fail on length."""
    parts = []
    for r in rules:
        num, _, den = r.expression.partition(" / ")
        x = f"CAST({num} AS DOUBLE)" + (f" / GREATEST({den}, 1)" if den else "")
        parts += [f"{x} >= {r.low}"] * (r.low is not None) + [f"{x} <= {r.high}"] * (r.high is not None)
    return F.expr(" AND ".join(parts) or "true")


def measure(docs: DataFrame) -> DataFrame:
    """The counts that rules refer to, beside doc_id; see quality()."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("t"))
    d = d.select(
        "doc_id",
        F.filter(F.split("t", GAP + "+"), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
    )
    stop = F.array(*[F.lit(x) for w in dict.fromkeys(STOP_WORDS) for x in (w, w[0].upper() + w[1:])])
    windows = F.when(F.size("w") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("w") - WINDOW + 1), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))).otherwise(F.array().cast("array<long>"))
    d = d.select(
        "doc_id", "w", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size(F.array_intersect(stop, F.col("w"))).cast("long").alias("n_stop_words"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("l", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•‣◦]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("l", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        windows.alias("h"),
    )
    # only texts in which some window's hash recurs are sorted; neighbours in that order are compared word by word
    again = F.size(F.array_distinct("h")) < F.size("h")
    ordered = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("s", F.when(again, ordered).otherwise(F.array().cast("array<struct<h:long,i:int>>"))).drop("h")

    def twin(x: Column, y: Column) -> Column:
        return y.isNotNull() & (x["h"] == y["h"]) & (F.slice("w", x["i"] + 1, WINDOW) == F.slice("w", y["i"] + 1, WINDOW))

    found = F.filter("s", lambda x, i: twin(x, F.get("s", i - 1)) | twin(x, F.get("s", i + 1)))
    d = d.withColumn("at", F.sort_array(F.transform(found, lambda x: x["i"]))).drop("s", "w")
    steps = F.transform("at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - x, F.lit(WINDOW))))
    # a term that isn't deterministic, and comes to nothing, keeps filters on the outcome from being pushed below, where each
    # reference to a list would make it anew
    total = F.aggregate(steps, F.spark_partition_id(), lambda a, b: a + b) - F.spark_partition_id()
    return d.withColumn("n_repeat_words", total.cast("long")).drop("at")


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, counts of stop
    words and lines) for every row of docs(doc_id, text, ...).

    All within one row: no shuffle, no user function. Null or empty text has no words or lines, so base_failed is
    true and kept false. Lines without a word don't count. A repeated window's words count once, its first
    occurrence included. Null doc_ids and repeated rows pass through; columns other than doc_id and text are ignored.
    """
    failed = ~compile_rules(tuple(Rule(r.name, r.expression, r.low, None if r.name == "length" else r.high) for r in rules if r.name in BASE))
    counts = measure(docs)
    verdict = compile_rules(tuple(r for r in rules if r.name not in BASE))
    high = compile_rules(tuple(Rule(r.name, r.expression, None, r.high) for r in rules if r.name == "length" and r.high is not None))
    return counts.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & high & verdict).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


_STOP = ", ".join(f"'{x}'" for w in dict.fromkeys(STOP_WORDS) for x in (w, w[0].upper() + w[1:]))
OP5_SQL = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select r, i, array_to_string(w[i:i+7], ' ') as s from (select r, w, unnest(generate_series(1, len(w) - 7)) as i from w where len(w) >= 8)),
h as (select r, i from g where (r, s) in (select (r, s) from g group by r, s having count(*) > 1)),
k as (select r, sum(least(8, coalesce(nx - i, 8)))::bigint as n from (select r, i, lead(i) over (partition by r order by i) as nx from h) group by r),
c as (select w.r, doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(k.n, 0)::bigint as n_repeat_words,
  len(list_intersect([{_STOP}], w))::bigint as n_stop_words, len(l)::bigint as n_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{{2022}}\x{{2023}}\x{{25E6}}]')))::bigint as n_bullet_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$')))::bigint as n_ellipsis_lines
  from w left join k using (r)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and n_words <= 100000 and word_chars::double / greatest(n_words, 1) between 2.5 and 14
  and n_symbols::double / greatest(n_words, 1) <= 0.1 and n_stop_words >= 2
  and n_dup_lines::double / greatest(n_lines, 1) <= 0.5 and n_bullet_lines::double / greatest(n_lines, 1) <= 0.9
  and n_ellipsis_lines::double / greatest(n_lines, 1) <= 0.3 as kept,
  n_stop_words, n_lines, n_bullet_lines, n_ellipsis_lines
from b
"""
