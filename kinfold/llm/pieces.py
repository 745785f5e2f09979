"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import blob, slices, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Most words that a task's table holds before it starts afresh, and the longest word that it keeps.
TABLE_ROWS, LONGEST = 500_000, 200
#: A marked word: markers (a space is one), then all up to the next marker.
_WORD = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")


@lru_cache(maxsize=4)
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def model_path(model: str | None) -> str:
    if model:
        return model
    import public_tokenizers

    return public_tokenizers.path(MODEL)


@lru_cache(maxsize=4)
def separable(model: str) -> bool:
    """Whether marked words can be segmented apart: no piece has a marker after another character, the text is
    not altered before segmentation, and one marker is put before it."""
    sp = processor(model)
    apart = all(MARK not in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))
    sample = "  a  B ﬁ Å é\t c "
    return apart and sp.decode(sp.encode(sample)) == sample and sp.encode(" a")[:1] == [sp.piece_to_id(MARK)]


class WordTable:
    """Distinct marked words with their ids (as int32 bytes) and surface; each is segmented once."""

    def __init__(self, model: str) -> None:
        self.sp, self.apart = processor(model), separable(model)
        self.rows: dict[str, tuple[bytes, str]] = {}

    def add(self, words: Iterable[str]) -> None:
        if len(self.rows) > TABLE_ROWS:
            self.rows.clear()
        new = [w for w in words if w not in self.rows]
        # the library puts a marker in front, in the place of the word's own first one
        for w, ids in zip(new, self.sp.encode([w[1:] for w in new], num_threads=1)):
            ids = ids or [self.sp.piece_to_id(MARK)]  # a marker alone
            self.rows[w] = np.array(ids, np.int32).tobytes(), " " + self.sp.decode(ids)

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """The ids and the decoded text of each text."""
        if not self.apart:
            ids = self.sp.encode(texts, num_threads=1)
            return [np.array(x, np.int32).tobytes() for x in ids], [self.sp.decode(x) for x in ids]
        parts = [_WORD.findall(" " + t) if t else [] for t in texts]
        self.add({w for p in parts for w in p})
        at = self.rows.__getitem__
        found = [[at(w) for w in p] for p in parts]
        out = [b"".join([x[0] for x in f]) for f in found], ["".join([x[1] for x in f])[1:] for f in found]
        for w in {w for p in parts for w in p if len(w) > LONGEST}:
            del self.rows[w]
        return out


def _run(model: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(model_path(model))
        for batch in batches:
            chars, bounds = blob(batch.column(1))
            for i, j in slices(bounds):
                texts = [chars[bounds[k] : bounds[k + 1]].tobytes().decode() for k in range(i, j)]
                ids, decoded = words.encode(texts)
                at = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                flat = pa.Array.from_buffers(pa.int32(), int(at[-1]), [None, pa.py_buffer(b"".join(ids))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at), flat), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded) for every row of docs(doc_id, text, ...): the library's ids of the whole
    text, without begin and end ids, and its decoding of them.

    Each task keeps a table of the distinct marked words that it has met, segments new ones once, and joins their
    ids back by position; nothing is shuffled, and a lost task is repeated alone. The table is bounded (TABLE_ROWS
    words of up to LONGEST characters). A model whose pieces cross markers is applied to whole texts instead.
    Null or empty text gives no ids and empty text; repeated rows and null doc_ids pass through; other columns are
    ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(_run(model), "doc_id long, ids array<int>, decoded string")


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, decoded) for rows(doc_id, ids array<int>); null ids give empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model_path(model))
        for batch in batches:
            texts = [sp.decode(x) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
