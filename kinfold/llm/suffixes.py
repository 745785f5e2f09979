"""Exact substring dedup: suffix arrays over candidate contexts, shard by shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import blob, cut, fresh, partitions, release, slices, stored, table
from kinfold.llm.kernels import SPACE, U, mix, powers, prefix_hash, span_hash, words as word_bounds

#: Bytes of a string whose repeats go, and of the grams among which every such string's anchor is chosen.
LENGTH, GRAM = 400, 16
#: Bytes that stand for a word where runs of words are compared.
CODE = 4
#: Words of a passage: runs of more than 50 words that stand anywhere else too.
PASSAGE_WORDS = 51
#: Bytes of contexts that one suffix array is made over, and contexts of one anchor value that a shard takes.
SHARD_BYTES, SHARD_ROWS = 1_000_000, 1500
#: Starts of one context at most, and bytes of a text that contexts are found in at a time.
RUN, PIECE = 65_536, 1_000_000


# ---------------------------------------------------------------- suffix arrays


def pack8(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first eight bytes of every suffix as a big-endian number; bytes past its string's end count as 0."""
    n = len(text)
    out = np.zeros(n + 8, U)
    out[:n] = text
    for k in (1, 2, 4):  # from one byte to two, four and eight
        out[: n + 8 - k] = out[: n + 8 - k] << U(8 * k) | out[k:]
        out[n + 8 - k :] <<= U(8 * k)
    out = out[:n]
    near = np.flatnonzero(left < 8)
    out[near] &= ~U(0) << (U(64) - U(8) * left[near].astype(U))
    return out


def pack2(codes: np.ndarray) -> np.ndarray:
    """The first two digests of every suffix as one number; the last one's second is 0."""
    out = codes.astype(U) << U(32)
    out[:-1] |= codes[1:]
    return out


def _sorted_by(high: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
    """Indices that sort by (high, low), both at most n. Where three numbers fit into a word, the words themselves are
    sorted, which takes a fraction of an indirect sort's time."""
    bits = max(1, int(n).bit_length())
    if 3 * bits <= 64:
        key = (high.astype(U) << U(2 * bits)) | (low.astype(U) << U(bits)) | np.arange(len(high), dtype=U)
        key.sort()
        return (key & ((U(1) << U(bits)) - U(1))).astype(np.int64)
    return np.lexsort((low, high))


def suffix_array(text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, packed first eight bytes) of many strings laid end to end; left[i] is the number of symbols
    from i to its string's end, where its suffix ends. Symbols are bytes, or words' digests of CODE bytes. Equal suffixes
    stand in order of place.

    Larsson-Sadakane refinement: suffixes are sorted by their first five bytes (one digest), then only groups that are still
    tied are sorted again by the rank of the suffix h symbols on, for h = 5, 10, 20, ... (1, 2, 4, ...)
    """
    n = len(text)
    words, h, rest = (pack8(text, left), 5, U(24)) if text.itemsize == 1 else (pack2(text), 1, U(32))
    # a short suffix goes before a longer one that agrees with it but for zero bytes
    short = np.minimum(left, h).astype(U)
    if n < 1 << 21:
        key = (words >> rest << rest) | (short << U(21)) | np.arange(n, dtype=U)
        key.sort()
        order = (key & U((1 << 21) - 1)).astype(np.int64)
        key >>= U(21)
    else:
        key = words >> rest << U(3) | short
        order = np.argsort(key)
        key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = head + 1
    longest = int(left.max(initial=0))
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied) and h < longest:
        at = order[tied]
        high = rank[at]
        low = np.where(left[at] > h, rank[np.minimum(at + h, n - 1)], 0)
        by = _sorted_by(high, low, n)
        at, high, low = at[by], high[by], low[by]
        order[tied] = at
        new = np.ones(len(at), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        head = np.maximum.accumulate(np.where(new, tied, 0))
        rank[at] = head + 1
        tied = tied[~(new & np.append(new[1:], True))]
        h *= 2
    if len(tied):
        at = order[tied]
        order[tied] = at[_sorted_by(rank[at], at, n)]
    return order, words


def common_prefixes(text: np.ndarray, left: np.ndarray, order: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, before): for every place, the symbols that its suffix shares with the one before it in order, and that one's
    place (-1 for none). Kasai's rule in text order: where the preceding bytes agree, the value is one less than the
    place before has; only the other places are compared, eight bytes at a time."""
    n, per, bits = len(text), 8 // text.itemsize, 8 * text.itemsize
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    prev = np.maximum(before, 0)
    begins = np.ones(n, bool)
    begins[1:] = left[1:] >= left[:-1]
    same = np.zeros(n, bool)
    same[1:] = (before[1:] >= 0) & ~begins[1:] & ~begins[prev[1:]] & (text[:-1] == text[prev[1:] - 1])
    # Kasai's rule needs the neighbours of both places to be each other's; ties in order of place give that
    same[1:] &= before[:-1] == prev[1:] - 1
    at = np.flatnonzero(~same)
    size = np.zeros(len(at), np.int64)
    live = np.flatnonzero(before[at] >= 0)
    while len(live):
        i = at[live] + size[live]
        j = prev[at[live]] + size[live]
        most = np.minimum(left[at[live]], left[prev[at[live]]]) - size[live]
        inside = most > 0
        i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
        x = words[i] ^ words[j]
        shared = np.full(len(live), per, np.int64)
        for k in range(per - 1, -1, -1):
            shared[(x >> U(64 - bits * (k + 1))) & U((1 << bits) - 1) != 0] = k
        step = np.where(inside, np.minimum(shared, most), 0)
        size[live] += step
        live = live[step == per]
    own = np.zeros(n, np.int64)
    own[at] = size
    last = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    return own[last] - (np.arange(n) - last), before


def repeated_starts(text: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which places of the strings text[bounds[i]:bounds[i+1]] begin a string of length symbols that also begins at another."""
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(text))
    order, words = suffix_array(text, left)
    prefix, before = common_prefixes(text, left, order, words)
    hit = prefix >= length
    hit[before[np.flatnonzero(hit)]] = True
    return hit


# ---------------------------------------------------------------- contexts


def contexts(chars: np.ndarray, bounds: np.ndarray, length: int = LENGTH, step: int = 1) -> tuple[np.ndarray, ...]:
    """(document, first start, last start, anchors, anchor value, hash) of each context.

    The anchor of a string of length bytes is its gram with the smallest hash (the first of several), so equal strings have
    equal anchors. A run of starts whose anchors have one value is a context; it spans the bytes of its strings.
    Strings and grams start at multiples of step, of which the texts' sizes, length and GRAM are multiples.
    """
    n, bounds, size, gram = len(chars) // step, bounds // step, length // step, GRAM // step
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, np.int64))
    if n < size:
        return empty
    p = prefix_hash(chars)
    _, down = powers(len(chars) + 1)
    own = p[::step]
    grams = mix((own[gram:] - own[:-gram]) * down[::step][: n - gram + 1])
    bits = U(max(22, n.bit_length()))
    placed = (grams >> bits << bits) | np.arange(len(grams), dtype=U)
    w = size - gram + 1
    padded = np.full(-(-len(placed) // w) * w + w, ~U(0), U)
    padded[: len(placed)] = placed
    square = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(square, 1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
    low = np.minimum(back[: n - size + 1], ahead[w - 1 : n - size + w])
    anchor = (low & ((U(1) << bits) - U(1))).astype(np.int64)
    doc_of = np.repeat(np.arange(len(bounds) - 1), np.maximum(np.diff(bounds) - size + 1, 0))
    first = np.cumsum(np.concatenate(([0], np.maximum(np.diff(bounds) - size + 1, 0))))
    start = np.arange(len(doc_of)) - first[doc_of] + bounds[doc_of]
    if not len(start):
        return empty
    a = anchor[start]
    value = grams[a]
    new_doc = np.ones(len(start), bool)
    new_doc[1:] = doc_of[1:] != doc_of[:-1]
    new_anchor = new_doc.copy()
    new_anchor[1:] |= a[1:] != a[:-1]
    new = new_doc.copy()
    new[1:] |= value[1:] != value[:-1]
    if len(new) > RUN // step:  # a periodic text would make one context of any size
        place = np.arange(len(new))
        new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % (RUN // step) == 0
        new_anchor |= new
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(start)) - 1
    count = np.add.reduceat(new_anchor.astype(np.int64), at)
    doc, lo, hi = doc_of[at], start[at], start[end]
    code = span_hash(p, lo * step, hi * step + length)
    return doc, (lo - bounds[doc]) * step, (hi - bounds[doc]) * step, count, value[at].view(np.int64), code.view(np.int64)


def word_codes(chars: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text's words as digests of CODE bytes, one after the other: bytes, bounds per text."""
    start, end, first = word_bounds(chars, bounds)
    code = (span_hash(prefix_hash(chars), start, end) >> U(32)).astype(np.uint32)
    return code.view(np.uint8), first * CODE


def _all_codes(data: np.ndarray) -> np.ndarray:
    """word_codes() of one text, about PIECE bytes at a time, cut where white space is."""
    parts, i = [], 0
    while i < len(data):
        j = min(i + PIECE, len(data))
        while j < len(data) and not SPACE[data[j]]:
            j = min(j + 1 + int(np.argmax(np.append(SPACE[data[j + 1 : j + PIECE]], True))), len(data))
        parts.append(word_codes(data[i:j], np.array([0, j - i]))[0])
        i = j
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def _pieces(data: np.ndarray, at: np.ndarray, length: int, step: int = 1) -> Iterator[tuple[np.ndarray, ...]]:
    """contexts() of some texts, or of one, a piece at a time: strings that start in one piece have their contexts there."""
    if len(at) > 2 or len(data) <= PIECE:
        yield contexts(data, at, length, step)
        return
    for i in range(0, len(data) - length + 1, PIECE):
        part = data[i : i + PIECE + length - step]
        doc, lo, hi, *rest = contexts(part, np.array([0, len(part)]), length, step)
        yield doc, lo + i, hi + i, *rest


def _contexts(length: int, coded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, bounds = blob(batch.column(1))
            for i, j in slices(bounds, 1_000_000):
                data, at = cut(chars, bounds, i, j)
                if coded:
                    data, at = word_codes(data, at) if j - i > 1 else ((x := _all_codes(data)), np.array([0, len(x)]))
                for doc, lo, hi, count, value, code in _pieces(data, at, length, CODE if coded else 1):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(value), pa.array(code), pa.array(lo), pa.array(hi), pa.array(count)], ["tkey", "fp", "code", "lo", "hi", "anchors"])

    return run


def _fetch(length: int, coded: bool):
    """(text, tkey, wanted) to (fp, code, salt, salts, data): the bytes of the contexts that are wanted of each text. Copies of a
    text stand side by side; the first one does for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            size = 0
            for text, tkey, wanted in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                if tkey == last:
                    continue
                last = tkey
                data = text.as_buffer().to_pybytes()
                if coded:
                    data = _all_codes(np.frombuffer(data, np.uint8)).tobytes()
                for w in wanted.as_py():
                    for column, x in zip(out, (w["fp"], w["code"], w["salt"], w["salts"], data[w["lo"] : w["hi"] + length])):
                        column.append(x)
                    size += w["hi"] + length - w["lo"]
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())))], ["fp", "code", "salt", "salts", "data"])
                    out, size = ([], [], [], [], []), 0
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())))], ["fp", "code", "salt", "salts", "data"])

    return run


_SHARD = "fp long, code long, spans array<long>, salt int, salts int, part int, data binary"


def _spans(hit: np.ndarray, length: int, step: int = 1) -> list[int]:
    """Starts and ends of the bytes that strings at the hits, step bytes apart, cover, one after the other."""
    at = np.flatnonzero(hit) * step
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > length)
    first, last = at[np.concatenate(([0], gap + 1))], at[np.append(gap, len(at) - 1)] + length
    return np.column_stack([first, last]).ravel().tolist()


def _groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[tuple]]:
    """Rows (fp, code, salt, salts, data) in order of (fp, salt, code), each kind once, in lots of whole (fp, salt) groups of limit
    bytes at most, or of one group."""
    held: list[tuple] = []
    size = first = before = 0  # first: the last group's first row; before: bytes of the groups before it
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:2] == held[-1][:2]:
                continue
            if held and (row[0], row[2]) != (held[-1][0], held[-1][2]):
                first, before = len(held), size
            if first and size + len(row[4]) > limit:
                yield held[:first]
                held, size, first, before = held[first:], size - before, 0, 0
            held.append(row)
            size += len(row[4])
    if held:
        yield held


def _shard(length: int, step: int):
    """A suffix array over each lot; spans of each context, and where other shards have contexts with the same anchor value,
    its bytes, and digests of the shard's distinct strings in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, SHARD_BYTES):
            bounds = np.concatenate(([0], np.cumsum([len(r[4]) for r in rows])))
            text = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
            sizes = (np.diff(bounds) - length) // step + 1
            owner = np.repeat(np.arange(len(rows)), sizes)
            at = (np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]) * step + bounds[owner]
            own = span_hash(prefix_hash(text), at, at + length)
            # contexts none of whose strings' digests recurs need no suffix array
            by = np.sort(own)
            twice = by[1:][by[1:] == by[:-1]]
            near = np.minimum(np.searchsorted(twice, own), max(len(twice) - 1, 0))
            held = np.unique(owner[twice[near] == own]) if len(twice) else np.zeros(0, np.int64)
            spans: dict[int, list[int]] = {}
            if len(held):
                parts = [rows[k][4] for k in held.tolist()]
                cuts = np.concatenate(([0], np.cumsum([len(x) for x in parts]))) // step
                hit = repeated_starts(np.frombuffer(b"".join(parts), np.uint8 if step == 1 else np.uint32), cuts, length // step)
                spans = {k: _spans(hit[cuts[q] : cuts[q + 1]], length, step) for q, k in enumerate(held.tolist())}
            out = [(r[0], r[1], spans.get(k, []), r[2], r[3], None, r[4] if r[3] > 1 else None) for k, r in enumerate(rows)]
            shared: dict[tuple, list[np.ndarray]] = {}
            if any(r[3] > 1 for r in rows):
                first = np.concatenate(([0], np.cumsum(sizes)))
                for k, r in enumerate(rows):
                    if r[3] > 1:
                        shared.setdefault((r[0], r[2], r[3]), []).append(own[first[k] : first[k + 1]])
            for (fp, salt, salts), lists in shared.items():
                digests = np.unique(np.concatenate(lists))
                part = (digests >> U(33)).astype(np.int64) % salts
                out += [(fp, None, None, salt, salts, int(q), digests[part == q].tobytes()) for q in range(salts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["fp", "code", "spans", "salt", "salts", "part", "data"])
        release()

    return run


def _merge(key, pdf):
    """Cross-shard merging of one part of one anchor value's digests: each shard's sorted list is looked up by binary search in those of
    the shards so far; what two shards have goes back to all."""
    import pandas as pd

    seen, both = np.zeros(0, U), [np.zeros(0, U)]
    for data in pdf["digests"]:
        own = np.frombuffer(data, U)
        if len(seen):
            at = np.minimum(np.searchsorted(seen, own), len(seen) - 1)
            found = seen[at] == own
            both.append(own[found])
            own = own[~found]
        seen = np.sort(np.concatenate((seen, own)))
    twice = np.unique(np.concatenate(both))
    rows = [(key[0], salt, twice[np.isin(twice, np.frombuffer(data, U), assume_unique=True)].tobytes()) for salt, data in zip(pdf["salt"], pdf["digests"])]
    return pd.DataFrame([r for r in rows if r[2]], columns=["fp", "salt", "digests"])


def _lookup(length: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for fp, code, data, digests in zip(*(c.to_pylist() for c in batch.columns)):
                text = np.frombuffer(data, np.uint8)
                known = np.sort(np.frombuffer(b"".join(digests), U))
                at = np.arange(0, len(text) - length + 1, step)
                own = span_hash(prefix_hash(text), at, at + length)
                out.append((fp, code, _spans(known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own, length, step)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["fp", "code", "spans"])

    return run


def _without(text: np.ndarray, spans: list[int]) -> tuple[bytes, int, int]:
    """(bytes outside the spans, bytes removed, maximal removed runs)."""
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, spans[0::2], 1)
    np.add.at(edge, spans[1::2], -1)
    gone = np.cumsum(edge[:-1]) > 0
    return text[~gone].tobytes(), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


_REMOVED = "rid long, n_bytes long, n_removed long, n_spans long, kept binary"
_PASSAGES = "n_passages long, n_passage_bytes long, rest string"


def _remove(count: int | None):
    """(rid, text, spans, runs) to the columns of _REMOVED, and with a count to those of _PASSAGES: runs of count words, the bytes from
    their first to their last word, and what is left without spans and runs, null where that is the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, bounds = blob(batch.column(1))
            for i, j in slices(bounds, 8_000_000):
                n_removed, n_spans, kept, n_passages, n_bytes, rest = [], [], [], [], [], []
                for d in range(i, j):
                    text = chars[bounds[d] : bounds[d + 1]]
                    spans, runs = batch.column(2)[d].as_py() or [], batch.column(3)[d].as_py() or []
                    data, gone, pieces = _without(text, spans) if spans else (text.tobytes(), 0, 0)
                    n_removed.append(gone)
                    n_spans.append(pieces)
                    kept.append(data)
                    if count is not None:
                        passages = _bytes_of_runs(text, runs, count) if runs else []
                        n_passages.append(len(passages) // 2)
                        n_bytes.append(sum(passages[1::2]) - sum(passages[0::2]))
                        data = _without(text, spans + passages)[0] if passages else data
                        rest.append(data.decode("utf-8", "ignore") if spans or passages else None)
                columns = [batch.column(0).slice(i, j - i), pa.array(np.diff(bounds[i : j + 1])), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())]
                names = ["rid", "n_bytes", "n_removed", "n_spans", "kept"]
                if count is not None:
                    columns += [pa.array(n_passages, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(rest, pa.string())]
                    names += ["n_passages", "n_passage_bytes", "rest"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def repeated_runs(spark: SparkSession, docs: DataFrame, count: int) -> DataFrame:
    """(tkey, runs): like repeated_spans(), but of runs of count words that also start elsewhere, whatever their bytes and
    the white space between them; runs are in bytes of words' digests."""
    return _repeated(spark, _texts(docs), count * CODE, True).withColumnRenamed("spans", "runs")


def _bytes_of_runs(text: np.ndarray, runs: list[int], count: int) -> list[int]:
    """Runs of digests' bytes as spans of the text's bytes, from the first to the last of words that stand side by side and are
    covered. Words of which only some bytes of the digest are covered are outside."""
    start, end, _ = word_bounds(text, np.array([0, len(text)]))
    first, last = -(-np.array(runs[0::2], np.int64) // CODE), np.array(runs[1::2], np.int64) // CODE
    whole = last - first >= count
    edge = np.zeros(len(start) + 1, np.int32)
    np.add.at(edge, first[whole], 1)
    np.add.at(edge, last[whole], -1)
    step = np.diff(np.concatenate(([0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0])))
    return np.column_stack([start[np.flatnonzero(step == 1)], end[np.flatnonzero(step == -1) - 1]]).ravel().tolist()


def repeated_spans(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(tkey, spans): for each text with repeats (tkey is its MD5), starts and ends of the bytes covered by strings of
    length bytes that also start elsewhere, one after the other."""
    return _repeated(spark, _texts(docs), length)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("tkey", F.unhex(F.md5("text")))


def _repeated(spark: SparkSession, text: DataFrame, length: int, coded: bool = False) -> DataFrame:
    """repeated_spans() of text(text binary, tkey), or of its words' digests where coded; texts of one key are equal."""
    least = 2 * length // CODE - 1 if coded else length  # bytes of so many words at least
    found = stored(spark, text.where(F.octet_length("text") >= least).select("tkey", "text").mapInArrow(_contexts(length, coded), "tkey binary, fp long, code long, lo long, hi long, anchors long"), "contexts")
    # anchor values that occur once have no equal strings anywhere
    often = found.groupBy("fp").agg(F.sum("anchors").alias("n"), F.min("code").alias("c0"), F.max("code").alias("c1")).where("n > 1").select("fp", (F.col("c0") != F.col("c1")).alias("differ"))
    live = stored(spark, found.join(often, "fp"), "live")
    # equal contexts are counted, not compared: all of each is removed; one of each stands for them in the suffix array
    classes = live.groupBy("fp", "code").agg(F.count("*").alias("n"), F.min(F.struct("tkey", "lo", "hi")).alias("at"), F.max("differ").alias("differ"), F.max("anchors").alias("anchors"))
    classes = stored(spark, classes, "classes")
    compare = classes.where("differ or anchors > 1 and n = 1")
    size = F.sum(F.col("at.hi") - F.col("at.lo") + length)
    wide = compare.groupBy("fp").agg(F.greatest(F.ceil(F.count("*") / SHARD_ROWS), F.ceil(size / SHARD_BYTES)).cast("int").alias("salts")).where("salts > 1")
    wanted = compare.join(wide, "fp", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    wanted = wanted.select(F.col("at.tkey").alias("tkey"), F.struct("fp", "code", F.pmod(F.xxhash64("code"), F.col("salts")).cast("int").alias("salt"), "salts", "at.lo", "at.hi").alias("w"))
    wanted = wanted.groupBy("tkey").agg(F.collect_list("w").alias("wanted"))  # no more than a text has contexts
    rows = text.join(wanted, "tkey").select("text", "tkey", "wanted").mapInArrow(_fetch(length, coded), "fp long, code long, salt int, salts int, data binary")
    shards = rows.repartition(partitions(spark), "fp", "salt").sortWithinPartitions("fp", "salt", "code")
    done = stored(spark, shards.mapInArrow(_shard(length, CODE if coded else 1), _SHARD), "shards")
    spans = done.where("code is not null").select("fp", "code", "spans")
    lists = done.where("code is null").select("fp", "salt", "part", F.col("data").alias("digests"))
    if not lists.isEmpty():
        twice = lists.groupBy("fp", "part").applyInPandas(_merge, "fp long, salt int, digests binary").groupBy("fp", "salt").agg(F.collect_list("digests").alias("digests"))
        again = done.where("code is not null and salts > 1").join(twice, ["fp", "salt"]).select("fp", "code", "data", "digests")
        spans = spans.unionByName(again.mapInArrow(_lookup(length, CODE if coded else 1), "fp long, code long, spans array<long>"))
    spans = spans.where(F.size("spans") > 0)
    place = live.select("tkey", "fp", "code", "lo", "hi").distinct()
    whole = place.join(classes.where("n > 1").select("fp", "code"), ["fp", "code"]).select("tkey", F.array("lo", F.col("hi") + length).alias("s"))
    part = place.join(spans, ["fp", "code"]).select("tkey", F.transform("spans", lambda x: x + F.col("lo")).alias("s"))
    return whole.unionByName(part).groupBy("tkey").agg(F.flatten(F.collect_list("s")).alias("spans"))


def _spans_and_runs(spark: SparkSession, docs: DataFrame, length: int, count: int | None) -> DataFrame:
    """(tkey, spans, runs): repeated_spans() beside repeated_runs(), which are null without a count."""
    spans = repeated_spans(spark, docs, length)
    if count is None:
        return spans.withColumn("runs", F.lit(None).cast("array<long>"))
    return spans.join(repeated_runs(spark, docs, count), "tkey", "full")


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, count: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every row of docs(doc_id, text, ...): texts as UTF-8 bytes
    without each byte that a string of length bytes covers which also starts anywhere else, in the same text or another.

    1. Every string's anchor is its 16-byte gram of smallest hash, so equal strings share one; runs of strings with
       one anchor value are contexts. Values that occur once are done with.
    2. Equal contexts are counted and dealt with as a whole; one of each kind goes on, if its value has other kinds.
    3. Those go to shards of bounded size by anchor value, where a suffix array (Larsson-Sadakane refinement, Kasai's
       common prefixes) finds all repeated strings. A value with more contexts than a shard takes is salted over
       several; their sorted string digests are merged by binary search, part by part.
    4. Spans go back to the texts.

    Null or empty text: no bytes, nothing removed. Each row is a document, so repeated rows are copies of one another,
    and lose all if they have length bytes. Null doc_ids pass through; columns other than doc_id and text are ignored.

    With a count, passages too: maximal runs of words that are covered by runs of count words which also start anywhere
    else, however few bytes they have. n_passages, n_passage_bytes (from the first to the last word of each) and text,
    which is without the bytes of both, as cut_repeats() leaves it. The other columns don't depend on the count.
    """
    both = _spans_and_runs(spark, docs, length, count)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("tkey", F.unhex(F.md5("text")))
    joined = own.join(both, "tkey", "left").select("doc_id", "text", "spans", "runs")
    out = joined.mapInArrow(_remove(count), _REMOVED if count is None else f"{_REMOVED}, {_PASSAGES}").withColumnRenamed("rid", "doc_id")
    return out if count is None else out.withColumn("text", F.coalesce("rest", F.col("kept").cast("string"))).drop("rest")


def cut_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, count: int | None = None) -> DataFrame:
    """docs, all columns, with repeats removed from their texts as remove_repeats() does, and with a count also the words
    of every run of count words that also starts anywhere else, however few bytes it has. What is left of a character of
    which only some bytes went goes too; a null text stays null."""

    @F.pandas_udf("string")
    def left(text, spans, runs):
        import pandas as pd

        def rest(t, s, r):
            if t is None or s is None and r is None:
                return t
            data = np.frombuffer(t.encode(), np.uint8)
            gone = ([] if s is None else list(s)) + ([] if r is None else _bytes_of_runs(data, list(r), count))
            return _without(data, gone)[0].decode("utf-8", "ignore") if gone else t

        return pd.Series([rest(*x) for x in zip(text, spans, runs)], dtype=object)

    key, own, at, by = fresh(docs, "_text_key", "_own_key", "_spans", "_runs")
    spans = _spans_and_runs(spark, docs, length, count).select(F.col("tkey").alias(key), F.col("spans").alias(at), F.col("runs").alias(by))
    joined = docs.withColumn(own, F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))).join(spans, F.col(own) == F.col(key), "left")
    return joined.withColumn("text", F.when(F.col(key).isNull(), F.col("text")).otherwise(left("text", at, by))).drop(key, own, at, by)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark, table(spark, sf_dir, "documents"), count=PASSAGE_WORDS)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "n_passage_bytes", "text")
