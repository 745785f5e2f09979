"""Token counts of the sections of a document, from one encoding of the whole."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinfold.llm.common import blob, slices, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: What becomes of a token that crosses a boundary: it goes to the section of its first byte, or to the one that has most
#: of its bytes (the earlier one of equals).
RULES = ("first", "most")


@lru_cache(maxsize=2)
def encoding(path: str | None):
    """The encoding and each token's length in bytes."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, k in ranks.items():
        sizes[k] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def offsets(text: str, path: str | None = None) -> np.ndarray:
    """Where each token of text begins, in bytes, and at the end where the last one ends: tokens are exact byte strings,
    so their lengths add up to offsets."""
    enc, sizes = encoding(path)
    ids = np.array(enc.encode_ordinary(text), np.int64)
    return np.concatenate(([0], np.cumsum(sizes[ids]))).astype(np.int64)


def line_sections(data: np.ndarray) -> np.ndarray:
    """Bounds of sections that each end behind a newline, or with the text."""
    ends = np.flatnonzero(data == 10) + 1
    return np.concatenate(([0], ends if len(ends) and ends[-1] == len(data) or not len(data) else np.append(ends, len(data)))).astype(np.int64)


def attribute(token: np.ndarray, bounds: np.ndarray, rule: str = "first") -> tuple[np.ndarray, int]:
    """(tokens of each section bounds[k]:bounds[k + 1], number of tokens that cross a boundary). An interval join of two
    sorted lists by binary search; sections cover the text, and every token is counted once."""
    if len(bounds) < 2 or len(token) < 2:
        return np.zeros(max(len(bounds) - 1, 0), np.int64), 0
    begin, end = token[:-1], token[1:]
    section = np.searchsorted(bounds, begin, "right") - 1
    last = np.searchsorted(bounds, end - 1, "right") - 1
    cross = np.flatnonzero(last > section)
    if rule == "most":
        for k in cross.tolist():
            cuts = np.concatenate(([begin[k]], bounds[section[k] + 1 : last[k] + 1], [end[k]]))
            section[k] += int(np.argmax(np.diff(cuts)))
    return np.bincount(section, minlength=len(bounds) - 1), len(cross)


def token_counts(docs: DataFrame, rule: str = "first", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_sections, n_crossing, section_tokens array<long>) for every row of docs(doc_id, text, ...).

    The whole text is encoded once; sections are its lines, newline included. Counts of sections add up to n_tokens. Null or
    empty text has no tokens and no sections. Nothing is shuffled; repeated rows and null doc_ids pass through; other
    columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, bounds = blob(batch.column(1))
            for i, j in slices(bounds):
                found = []
                for k in range(i, j):
                    data = chars[bounds[k] : bounds[k + 1]]
                    found.append((*attribute(offsets(data.tobytes().decode(), path), line_sections(data), rule),))
                sizes = np.array([len(x[0]) for x in found], np.int64)
                at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                flat = np.concatenate([x[0] for x in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([int(x[0].sum()) for x in found], pa.int64()), pa.array(sizes), pa.array([x[1] for x in found], pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(np.int64)))],
                    ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
