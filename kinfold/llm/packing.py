"""Best-fit packing of documents into training sequences, under source and duplicate conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import blob, fresh, partitions, table
from kinfold.llm.tokencounts import offsets

#: Tokens of a sequence, documents that are packed together, and such lots that a task packs where there are many.
CAPACITY, LOT_DOCS, TASK_LOTS = 4096, 4096, 64
_PIECE = "lot long, bin long, position int, doc_id long, piece int, start long, end long, tokens int"


class Bins:
    """Open bins in order of residual space. Each carries a bitmap of the sources and one of the duplicate clusters that it
    holds; a search begins at the tightest bin that is large enough and goes on to the next until one is compatible."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.count = 0

    def place(self, units: int, source: int, cluster: int) -> int:
        k = bisect_left(self.order, (units, -1))
        while k < len(self.order):
            residual, b = self.order[k]
            if not (self.sources[b] >> source & 1 or self.clusters[b] >> cluster & 1):
                del self.order[k]
                break
            k += 1
        else:
            b, residual = self.count, self.capacity
            self.count += 1
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[b] |= 1 << source
        self.clusters[b] |= 1 << cluster
        if residual > units:
            insort(self.order, (residual - units, b))
        return b


def token_cuts(data: np.ndarray, token: np.ndarray, capacity: int) -> tuple[list[int], list[int]]:
    """(byte bounds, tokens) of the pieces of a text whose tokens begin at these bytes: capacity tokens each, or up to three
    fewer where a character would be cut (but one at least); no bytes are one piece without tokens."""
    n, at, cuts, tokens = len(token) - 1, 0, [0], []
    while at < n:
        to = min(at + capacity, n)
        while at + 1 < to < n and data[token[to]] & 0xC0 == 0x80:
            to -= 1
        cuts.append(int(token[to]))
        tokens.append(to - at)
        at = to
    return (cuts, tokens) if tokens else ([0, 0], [0])


def _sizes(capacity: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, bounds = blob(batch.column(3))
            found = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                data = chars[a:b]
                found.append(token_cuts(data, offsets(data.tobytes().decode(), path), capacity))
            lists = [pa.array([x[k] for x in found], pa.list_(t)) for k, t in ((0, pa.int64()), (1, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], ["doc_id", "source", "cluster", "cuts", "tokens"])

    return run


def pack_lot(rows: list[tuple], capacity: int) -> list[tuple]:
    """(doc_id, byte bounds, tokens, source, cluster) to (bin, position, doc_id, piece, start, end, tokens), largest pieces first.
    Whole sequences of a text that is longer than one are closed; what is left of it is packed."""
    pieces = [(size, n, k, a, b) for n, (_, cuts, tokens, *_) in enumerate(rows) for k, (size, a, b) in enumerate(zip(tokens, cuts, cuts[1:]))]
    pieces.sort(key=lambda x: (-x[0], x[1], x[2]))
    number: tuple[dict, dict] = {}, {}
    ids = [[seen.setdefault(r[c], len(seen)) for r in rows] for c, seen in ((3, number[0]), (4, number[1]))]
    bins, held, out = Bins(capacity), {}, []
    for size, n, k, a, b in pieces:
        at = bins.place(size, ids[0][n], ids[1][n])
        position = held[at] = held.get(at, -1) + 1
        out.append((at, position, rows[n][0], k, a, b, size))
    return out


def _run(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(lot: int, rows: list[tuple]) -> pa.RecordBatch:
            out = [(lot, *x) for x in pack_lot(rows, capacity)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()))], ["lot", "bin", "position", "doc_id", "piece", "start", "end", "tokens"])

        lot, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != lot:
                    if held:
                        yield packed(lot, held)
                    lot, held = row[0], []
                held.append(row[1:])
        if held:
            yield packed(lot, held)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, lot_docs: int = LOT_DOCS, cluster: str | None = None, path: str | None = None) -> DataFrame:
    """(lot, bin, position, doc_id, piece, start, end, tokens) for docs(doc_id, text, source, ...): each text, or each piece
    of one longer than a sequence (bytes start to end of its UTF-8), in a bin of its lot. A bin holds at most capacity
    tokens, no two pieces of one source, and no two of one duplicate cluster. Tokens are those of the whole text's encoding
    with the vocabulary at path; pieces end between tokens, and between characters.

    A cluster is the column of that name (say, a component_id of near duplicates), or where it is null or not given, texts
    equal but for case and white space. Documents are dealt to lots of about lot_docs by a hash of doc_id and cluster,
    as many lots as the corpus needs, and a lot is packed by itself, best fit in order of falling size: memory is bounded
    and a lost task is repeated alone. A hot source costs bins, as its pieces may not meet; no document is left out. Null or
    empty text is a piece of 0 tokens. A null source is a source. Repeated rows conflict with one another; null doc_ids
    pass through; other columns are ignored.
    """
    if capacity < 4:
        raise ValueError("a character can take four tokens")
    (mine,) = fresh(docs, "_cluster")
    data = F.coalesce("text", F.lit(""))
    folded = F.md5(F.lower(F.regexp_replace(F.trim(data), r"\s+", " ")).cast("binary"))
    own = docs.withColumn(mine, folded if cluster is None else F.coalesce(F.col(cluster).cast("string"), folded))
    sized = own.select("doc_id", "source", F.col(mine).alias("cluster"), data.alias("text")).mapInArrow(_sizes(capacity, path), "doc_id long, source string, cluster string, cuts array<long>, tokens array<int>")
    n = docs.agg(F.count("*")).first()[0]  # from the files' footers
    lots = max(1, -(-n // lot_docs))
    tasks = min(lots, max(partitions(docs.sparkSession), -(-lots // TASK_LOTS)))
    dealt = sized.withColumn("lot", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(lots)))
    dealt = dealt.select("lot", "doc_id", "cuts", "tokens", "source", "cluster").repartition(tasks, "lot").sortWithinPartitions("lot", "doc_id", "cluster", "cuts", "tokens", "source")
    return dealt.mapInArrow(_run(capacity), _PIECE)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
