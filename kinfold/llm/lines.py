"""Line dedup over a whole corpus: equal lines and lines a few edits apart, by a deletion-neighbourhood join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import blob, cut, fresh, slices, stored, table
from kinfold.llm.kernels import U, mix, powers

#: Lines from so many characters on have near lines in the query and in the pipeline: in a shorter one an edit changes what it says.
NEAR_CHARS = 20
#: Variants that are made at a time.
_MANY = 500_000
_WILD = U(0x9FB21C651E98DF25)
_AT = "at struct<doc_id:long,text_key:long,line_no:int>"
_LINE = "k1 long, k2 long, doc_id long, text_key long, line_no int, keys array<long>"
#: Code points that are white space; the last one stands for all above.
_WHITE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
_codes: list[np.ndarray] = []


def _prefix(raw: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial hash of the code points before i."""
    if not _codes:
        _codes.append(np.random.default_rng(11).integers(1, 1 << 63, 0x110000, dtype=np.uint64) * U(2) + U(1))
    up, _ = powers(len(raw) + 1)
    p = np.zeros(len(raw) + 1, U)
    np.cumsum(_codes[0][raw] * up[: len(raw)], out=p[1:])
    return p


def split_lines(chars: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(code points, document, number in it, start, end, byte start, byte end) of all \\n-separated lines."""
    raw = np.frombuffer(chars.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = (chars & 0xC0) != 0x80
    begins = np.concatenate(([0], np.cumsum(lead)))[bounds]
    byte = np.append(np.flatnonzero(lead), len(chars))
    nl = np.flatnonzero(raw == 10)
    n = len(bounds) - 1
    doc = np.concatenate((np.arange(n), np.searchsorted(begins[1:], nl, "right")))
    start = np.concatenate((begins[:-1], nl + 1))
    by = np.lexsort((start, doc))
    doc, start = doc[by], start[by]
    end = np.append(start[1:] - 1, 0)
    last = np.append(np.flatnonzero(np.diff(doc)), len(doc) - 1)
    if n:
        end[last] = begins[1:]
    first = np.searchsorted(doc, np.arange(n))
    return raw, doc, np.arange(len(doc)) - first[doc], start, end, byte[start], byte[end]


def key_kinds(edits: int) -> list[tuple[int, int, int]]:
    """(characters less, segment, shift) of each segment key of a line. The first edits + 1 are the line's own segments (no
    characters less, no shift). The others are where a line that is so many characters shorter would have its segments."""
    out = [(0, j, 0) for j in range(edits + 1)]
    for less in range(edits + 1):
        for j in range(edits + 1):
            shifts = [0] if j == 0 else [less] if j == edits else [t for t in range(-edits, edits + 1) if abs(t) + abs(less - t) <= edits]
            out += [(less, j, t) for t in shifts if (less, t) != (0, 0)]
    return out


def segment_keys(p: np.ndarray, start: np.ndarray, end: np.ndarray, edits: int) -> np.ndarray:
    """A row of keys a line, in the order of key_kinds(). Of two lines within so many edits, one segment of the shorter is
    untouched (there is one more than edits), so one of its own keys is a key of the longer."""
    _, down = powers(len(p) + 1)
    size = end - start
    out = []
    for less, j, shift in key_kinds(edits):
        length = np.maximum(size - less, 0)
        a = np.clip(start + length * j // (edits + 1) + shift, start, end)
        b = np.clip(start + length * (j + 1) // (edits + 1) + shift, start, end)
        out.append(mix((p[b] - p[a]) * down[a] ^ mix((length * (edits + 1) + j).astype(U))))
    return np.column_stack(out).view(np.int64)


def _lists(rows: np.ndarray, at: np.ndarray) -> pa.Array:
    """One list a place: a row where at holds, null elsewhere."""
    offsets = np.concatenate(([0], np.cumsum(at))).astype(np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~at, False)), pa.array(rows.ravel()))


def _scan(min_chars: int, edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, bounds = blob(batch.column(2))
            for i, j in slices(bounds):
                data, at = cut(chars, bounds, i, j)
                raw, doc, number, start, end, b0, b1 = split_lines(data, at)
                filled = np.concatenate(([0], np.cumsum(~_WHITE[np.minimum(raw, len(_WHITE) - 1)])))
                own = np.flatnonzero(filled[end] > filled[start])  # lines that have more than white space
                near = ((end - start)[own] >= min_chars) & (edits > 0)
                keys = segment_keys(_prefix(raw), start[own[near]], end[own[near]], max(edits, 1))
                whole = data.tobytes()
                names = np.frombuffer(b"".join(hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(b0[own].tolist(), b1[own].tolist())), np.int64).reshape(-1, 2)
                docs = pa.array(doc[own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[:, 0]), pa.array(names[:, 1]), batch.column(0).slice(i, j - i).take(docs), batch.column(1).slice(i, j - i).take(docs), pa.array(number[own].astype(np.int32)), _lists(keys, near)],
                    ["k1", "k2", "doc_id", "text_key", "line_no", "keys"],
                )

    return run


def patterns(p: np.ndarray, changed: int, dropped: int) -> Iterator[np.ndarray]:
    """Hashed keys of all ways to leave out dropped characters of a line and to put a blank in the place of changed others, some at a
    time; p is the line's prefix hash. Keys tell numbers of blanks and lengths apart."""
    n = len(p) - 1
    up, down = powers(n + 2)

    def grow(h: np.ndarray, at: np.ndarray, edits: tuple[str, ...], gone: int) -> Iterator[np.ndarray]:
        if not edits:
            yield mix(h + (p[n] - p[at]) * down[gone] ^ mix(np.array([(n - dropped) * 64 + changed], U)))
            return
        left = n - at
        if len(at) > 1 and left.sum() > _MANY:
            half = len(at) // 2
            yield from grow(h[:half], at[:half], edits, gone)
            yield from grow(h[half:], at[half:], edits, gone)
            return
        row = np.repeat(np.arange(len(at)), left)
        place = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(left) - left, left)
        h = h[row] + (p[place] - p[at[row]]) * down[gone]
        if edits[0] == "change":
            yield from grow(h + _WILD * up[place - gone], place + 1, edits[1:], gone)
        else:
            yield from grow(h, place + 1, edits[1:], gone + 1)

    for edits in sorted(set(permutations(("change",) * changed + ("drop",) * dropped))):
        for keys in grow(np.zeros(1, U), np.zeros(1, np.int64), edits, 0):
            yield np.unique(keys) if dropped else keys


def wanted_patterns(mask: int, edits: int) -> list[tuple[int, int]]:
    """The (changed, dropped) whose patterns a line needs, if bit 0 of mask says that a line of its length may be near, bit k that one
    k characters shorter may, and bit edits + k that one k characters longer may. Lines a and b are within edits if a
    pattern of a with d dropped equals one of b with e dropped, c blanks in each, and c + d + e <= edits."""
    out = set()
    for k in range(edits + 1):
        for both in range(edits + 1):
            for changed in range(edits - k - 2 * both + 1):
                if mask >> k & 1:
                    out.add((changed, k + both))
                if mask >> (edits + k if k else 0) & 1:
                    out.add((changed, both))
    return sorted(out - ({(0, 0)} if mask == 1 else set()))


def _variants(edits: int):
    """(k1, k2, at, text, mask) to (k1, k2, at, changed, dropped, key): the patterns of each line that it needs."""
    names = ["k1", "k2", "at", "changed", "dropped", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, int, int, np.ndarray]] = []

            def flush() -> pa.RecordBatch:
                sizes = [len(x[3]) for x in held]
                spread = lambda k, t: np.repeat(np.array([x[k] for x in held], t), sizes)
                take = pa.array(spread(0, np.int64))
                keys = np.concatenate([x[3] for x in held]) if held else np.zeros(0, U)
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in (0, 1, 2)), pa.array(spread(1, np.int32)), pa.array(spread(2, np.int32)), pa.array(keys.view(np.int64))], names)

            for k, (text, mask) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                p = _prefix(np.frombuffer(text.encode("utf-32-le"), np.uint32))
                for changed, dropped in wanted_patterns(mask, edits):
                    for keys in patterns(p, changed, dropped):
                        held.append((k, changed, dropped, keys))
                        if sum(len(x[3]) for x in held) > _MANY:
                            yield flush()
                            held = []
            yield flush()

    return run


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, wanted) to one row a wanted line, with its text."""
    at = pa.struct([("doc_id", pa.int64()), ("text_key", pa.int64()), ("line_no", pa.int32())])
    for batch in batches:
        out = []
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = text.split("\n")
            out += [{"k1": w["k1"], "k2": w["k2"], "at": w["at"], "text": own[w["at"]["line_no"]], "mask": w["mask"]} for w in wanted]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("at", at), ("text", pa.string()), ("mask", pa.int32())]))


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows may share a doc_id, so a text's own hash is part of its place."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def repeated_lines(spark: SparkSession, docs: DataFrame, max_edits: int = 1, min_chars: int = 0) -> DataFrame:
    """(doc_id, text_key, line_no, kept_doc_id, kept_text_key, kept_line_no, edits): each line of docs(doc_id, text, ...) that an
    earlier line equals or comes within max_edits of (characters inserted, dropped or changed), and the earliest such line.

    Lines are what newlines separate, numbered from 0; blank ones are left alone, all others take part, however short.
    With min_chars, shorter lines go only where an earlier line equals them. Order is by (doc_id, text_key, line_no),
    text_key being the 64-bit hash of the text, which only matters for rows that share a doc_id. Whether a line goes
    doesn't depend on whether the earlier one does.

    1. Equal lines become one row with their earliest place.
    2. Segment keys tell which distinct lines can have a partner at all, and how much longer or shorter; only these go on.
    3. Each emits its deletion variants (and variants with a blank in a character's place, for substitutions) as hashed
       keys. Two lines that share a variant are partners if their edits add up to no more than max_edits; so the earliest
       place of a key's group is a partner of all others in it, and a minimum takes the place of pairs, however large the group.
    4. Edit distances of the lines found are verified on their texts.

    Joins are merge joins by hint: both their sides grow with the corpus, and what Spark takes for small enough to broadcast
    (by the size of compressed files) need not fit the driver. A line of n characters with a possible partner has about n ** max_edits variants, which are made and sent a part at
    a time. Null or empty text has no lines. A null doc_id sorts before all others. Rows equal in doc_id and text are at one
    place: none is earlier than the other, and the result has their lines once. Other columns are ignored.
    """
    if max_edits < 0:
        raise ValueError("max_edits is 0 or more")
    own = _keyed(docs)
    lines = stored(spark, own.mapInArrow(_scan(min_chars, max_edits), _LINE), "lines")
    at = F.struct("doc_id", "text_key", "line_no")
    kept = lines.groupBy("k1", "k2").agg(F.min(at).alias("first"), F.count("*").alias("n"))
    if max_edits:
        kept = kept.join(_earlier_within(spark, own, lines.where("keys is not null"), max_edits).hint("merge"), ["k1", "k2"], "left")
    else:
        kept = kept.withColumns({"near": F.lit(None).cast(_AT[3:]), "edits": F.lit(0)})
    kept = kept.where("n > 1 or near is not null").withColumn("keep", F.least("first", "near"))
    # stored, so that the join with all lines can be split where a line is very common
    kept = stored(spark, kept.select("k1", "k2", "keep", F.when(F.col("keep") == F.col("first"), 0).otherwise(F.col("edits")).alias("edits")), "kept-lines")
    out = lines.select("k1", "k2", "doc_id", "text_key", "line_no").join(kept.hint("merge"), ["k1", "k2"]).where(at > F.col("keep"))
    return out.select("doc_id", "text_key", "line_no", F.col("keep.doc_id").alias("kept_doc_id"), F.col("keep.text_key").alias("kept_text_key"), F.col("keep.line_no").alias("kept_line_no"), "edits").distinct()


def _earlier_within(spark: SparkSession, docs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """(k1, k2, near, edits): of each distinct line, the earliest place of another within so many edits, if before its own."""
    distinct = lines.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "text_key", "line_no")).alias("at"), F.first("keys").alias("keys"))
    distinct = stored(spark, distinct, "distinct-lines")
    keys = distinct.select("k1", "k2", F.posexplode("keys").alias("kind", "key"))
    own = F.col("kind") <= edits
    less = F.element_at(F.array(*[F.lit(x[0]) for x in key_kinds(edits)]), F.col("kind") + 1)
    bit = F.call_function("shiftleft", F.lit(1), less)
    groups = keys.groupBy("key").agg(F.count_if(own).alias("n_own"), F.bit_or(F.when(own, 0).otherwise(bit)).alias("longer")).where("n_own > 1 or n_own > 0 and longer > 0")
    # bit 0 for a line of the same length, bit k for one k shorter, bit edits + k for one k longer
    mine = F.when(F.col("n_own") > 1, 1).otherwise(0).bitwiseOR(F.col("longer").bitwiseAND(F.lit(1))).bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", F.col("longer"), F.lit(1)), F.lit(edits + 1)))
    found = keys.join(groups.hint("merge"), "key").groupBy("k1", "k2").agg(F.bit_or(F.when(own, mine).otherwise(F.when(F.col("n_own") > 0, bit).otherwise(0))).cast("int").alias("mask")).where("mask <> 0")
    wanted = found.hint("merge").join(distinct.select("k1", "k2", "at"), ["k1", "k2"])
    wanted = wanted.groupBy(F.col("at.doc_id").alias("d"), F.col("at.text_key").alias("t")).agg(F.collect_list(F.struct("k1", "k2", "at", "mask")).alias("wanted"))  # no more than a document has lines
    texts = docs.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))).select("text", "wanted")
    alive = texts.mapInArrow(_pick, f"k1 long, k2 long, {_AT}, text string, mask int").dropDuplicates(["k1", "k2"])
    alive = stored(spark, alive, "alive-lines")
    variants = alive.mapInArrow(_variants(edits), f"k1 long, k2 long, {_AT}, changed int, dropped int, key long")
    tops = variants.groupBy("key").agg(*[F.min(F.when(F.col("dropped") == k, F.col("at"))).alias(f"top{k}") for k in range(edits + 1)], F.count("*").alias("n")).where("n > 1")
    room = F.lit(edits) - F.col("changed") - F.col("dropped")
    partner = reduce(F.least, [F.when(room >= k, F.col(f"top{k}")) for k in range(edits + 1)])
    best = variants.join(tops.hint("merge"), "key").withColumn("near", partner).where(F.col("near") < F.col("at")).groupBy("k1", "k2", "at").agg(F.min("near").alias("near"))
    other = alive.select(F.col("at").alias("near"), F.col("text").alias("near_text"))
    checked = best.hint("merge").join(alive.select("k1", "k2", "text"), ["k1", "k2"]).join(other.hint("merge"), "near").withColumn("edits", F.levenshtein("text", "near_text", edits))
    return checked.where(F.col("edits").between(0, edits)).select("k1", "k2", "near", "edits")


def drop_lines(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the lines (doc_id, text_key, line_no) in gone; texts are joined again by newlines, null stays null."""
    key, code, mine, drop, own = fresh(docs, "_doc", "_code", "_mine", "_drop", "_own")
    lists = gone.groupBy(F.col("doc_id").alias(key), F.col("text_key").alias(code)).agg(F.collect_set("line_no").alias(drop))  # no more than a document has lines
    marked = docs.withColumn(mine, F.xxhash64("text"))
    joined = marked.join(lists.hint("merge"), F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(mine) == F.col(code)), "left").withColumn(own, F.when(F.col(drop).isNotNull(), F.split("text", "\n")))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), drop), lambda i: F.get(own, i))
    return joined.withColumn("text", F.when(F.col(own).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))).drop(key, code, mine, drop, own)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(spark, table(spark, sf_dir, "documents"), min_chars=NEAR_CHARS)
