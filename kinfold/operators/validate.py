"""Checks of result files: a finding for each rule that a file breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.sources.records import CANDIDATE_COLUMNS, RESULT_COLUMNS

FINDINGS = "severity string, rule string, n long, examples array<string>"


def _finding(rule: str, rows: DataFrame, example: Column, severity: str = "error") -> DataFrame:
    """One row if rows has any: how many distinct offenders and the first five."""
    e = rows.select(example.alias("e")).distinct()
    few = e.orderBy("e").limit(5).agg(F.array_sort(F.collect_list("e")).alias("examples"))
    n = e.agg(F.count("*").alias("n"))
    return n.crossJoin(few).where("n > 0").select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), "n", "examples")  # one row by one row


def parse_lines(lines: DataFrame) -> DataFrame:
    """(s1_id, list, tabs) of lines(value) without header and blank lines. A list of white space only is empty."""
    v = lines.where("trim(value) <> ''")
    cut = F.split("value", "\t", 2)
    return v.select(F.get(cut, 0).alias("s1_id"), F.coalesce(F.get(cut, 1), F.lit("")).alias("list"), F.contains("value", F.lit("\t")).alias("tabbed"))


def header_findings(header: str | None, expected: tuple[str, str]) -> list[tuple]:
    if header is None:
        return [("error", "empty_file", 1, [])]
    if "\t" not in header and "," in header:
        return [("error", "comma_header", 1, [header])]
    if tuple(x.strip().lower() for x in header.split("\t")) != expected:
        return [("error", "wrong_header", 1, [header])]
    return []


def list_findings(rows: DataFrame, required: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """Findings on parsed rows: required(eid) are the S1 ids that must occur, valid(eid) the ids that lists may have."""
    good = rows.where("tabbed")
    ids = good.where("trim(list) <> ''").select("s1_id", F.split("list", ",").alias("ids"))
    one = ids.select("s1_id", F.explode("ids").alias("id"))
    seen = good.select(F.col("s1_id").alias("eid"))
    out = [
        _finding("no_tab", rows.where("not tabbed"), F.col("s1_id")),
        _finding("duplicate_s1", good.groupBy("s1_id").count().where("count > 1"), F.col("s1_id")),
        _finding("duplicate_in_list", one.groupBy("s1_id", "id").count().where("count > 1"), F.concat_ws(":", "s1_id", "id")),
        _finding("self_match", one.where("id like 'S1-%'"), F.concat_ws(":", "s1_id", "id")),
        _finding("wrong_prefix", one.where("not (id like 'S1-%' or id like 'S2-%' or id like 'S3-%')"), F.concat_ws(":", "s1_id", "id")),
        _finding("missing_s1", required.select("eid").join(seen, "eid", "left_anti"), F.col("eid")),
        _finding("extra_s1", seen.join(required.select("eid"), "eid", "left_anti"), F.col("eid")),
    ]
    if valid is not None:
        out.append(_finding("unknown_id", one.where("id like 'S2-%' or id like 'S3-%'").join(valid.select(F.col("eid").alias("id")), "id", "left_anti"), F.concat_ws(":", "s1_id", "id")))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def not_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """A warning for matched pairs that aren't candidates; both parsed."""
    pair = lambda rows: rows.where("tabbed and trim(list) <> ''").select("s1_id", F.explode(F.split("list", ",")).alias("id")).distinct()
    return _finding("not_in_candidates", pair(matches).join(pair(candidates), ["s1_id", "id"], "left_anti"), F.concat_ws(":", "s1_id", "id"), "warning")


def _read(spark: SparkSession, path: str) -> tuple[str | None, DataFrame | None, list[tuple]]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None, None, [("error", "missing_file", 1, [path])]
    lines = spark.read.text(path)
    if not lines.where(~F.is_valid_utf8("value")).isEmpty():
        return None, None, [("error", "not_utf8", 1, [path])]
    first = lines.first()
    header = first["value"] if first else None
    return header, lines.where(F.col("value") != F.lit(header)) if header is not None else lines, []


def validate(spark: SparkSession, matching: str, required: DataFrame, candidates: str | None = None, valid: DataFrame | None = None) -> DataFrame:
    """Findings (severity, rule, n, examples) on a matching file and, if given, a candidate file. No errors: valid."""
    fixed: list[tuple] = []
    header, rows, bad = _read(spark, matching)
    fixed += bad or header_findings(header, RESULT_COLUMNS)
    parsed = parse_lines(rows) if rows is not None else None
    out = list_findings(parsed, required, valid) if parsed is not None and not fixed else None
    if valid is None:
        fixed.append(("warning", "ids_not_checked", 1, []))
    if candidates is None:
        fixed.append(("warning", "no_candidate_file", 1, []))
    else:
        header, rows, bad = _read(spark, candidates)
        found = [("warning", "no_candidate_file", 1, [candidates])] if bad and bad[0][1] == "missing_file" else bad or header_findings(header, CANDIDATE_COLUMNS)
        fixed += found
        if rows is not None and not found:
            c = parse_lines(rows)
            extra = list_findings(c, required, valid).withColumn("rule", F.concat(F.lit("candidates_"), "rule"))
            if parsed is not None:
                extra = extra.unionByName(not_candidates(parsed, c))
            out = extra if out is None else out.unionByName(extra)
    first = spark.createDataFrame(fixed, FINDINGS)
    return first if out is None else first.unionByName(out)


def exit_code(findings: DataFrame) -> int:
    return 0 if findings.where("severity = 'error'").isEmpty() else 1
