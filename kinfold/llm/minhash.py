"""MinHash near-duplicates with tensored banding, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.common import blob, cut, fresh, partitions, slices, stored, table
from kinfold.llm.components import components
from kinfold.llm.kernels import U, minhashes, mix, shingle_sets

#: Collections on each side and min-wise values in each: 2 * 16 * 3 = 96 values make 256 tables of six, for which
#: plain banding would take 1,536. A pair of similarity 0.8 misses them all with probability 2e-5, of 0.85 with 5e-7.
SIDE, DEPTH = 16, 3
#: Members and text bytes of a block of a candidate cluster; blocks are compared pair by pair in separate tasks.
BLOCK_ROWS, BLOCK_BYTES = 512, 2_000_000


def set_ids(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 128-bit id for each set, as rows of two words; equal sets have equal ids."""
    out = np.zeros((len(bounds) - 1, 2), U)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            out[full, k] = np.add.reduceat(mix(values ^ U(salt)), bounds[full])
        out[full, 1] += np.diff(bounds)[full].astype(U)
    return out


def half_keys(sig: np.ndarray) -> np.ndarray:
    """The 2 * SIDE keys of DEPTH values each; a table key is a left one with a right one."""
    part = sig.reshape(len(sig), 2 * SIDE, DEPTH).astype(U)
    h = np.arange(1, 2 * SIDE + 1, dtype=U) * U(0x9E3779B97F4A7C15) + np.zeros((len(sig), 1), U)
    for k in range(DEPTH):
        h = mix(h ^ part[:, :, k]) + U(k)
    return h.view(np.int64)


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, bounds = blob(batch.column(2))
            for i, j in slices(bounds):
                values, at = shingle_sets(*cut(chars, bounds, i, j), width)
                n = np.diff(at)
                ids = set_ids(values, at)
                keys = half_keys(minhashes(values, at, 2 * SIDE * DEPTH))
                cls = pa.array([x.tobytes() if k else None for x, k in zip(ids, n.tolist())], pa.binary())
                halves = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * 2 * SIDE), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(np.diff(bounds[i : j + 1])), cls, halves], ["doc_id", "text_key", "n_shingles", "n_bytes", "cls", "halves"])

    return run


def links(values: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of left x right sets have den * intersection >= num * union, exactly: products of 0/1 matrices over
    the shingles that occur twice or more, a tile of columns at a time."""
    n, size = len(at) - 1, np.diff(at)
    inter = np.zeros((len(left), len(right)), np.float32)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    v = values[order]
    new = np.concatenate(([True], v[1:] != v[:-1]))
    col = np.cumsum(new) - 1
    often = np.bincount(col)[col] > 1
    row, col = row[order][often], col[often]
    if len(col):
        col = np.cumsum(np.concatenate(([False], col[1:] != col[:-1])))
        tile = 2048
        for lo in range(0, int(col[-1]) + 1, tile):
            a, b = np.searchsorted(col, (lo, lo + tile))
            x = np.zeros((n, min(tile, int(col[-1]) + 1 - lo)), np.float32)
            x[row[a:b], col[a:b] - lo] = 1
            inter += x[left] @ x[right].T
    inter = inter.astype(np.int64)
    union = size[left][:, None] + size[right][None, :] - inter
    return den * inter >= num * union


def _forest(hit: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable of each of n nodes, where hit says which left and right nodes are linked."""
    root = np.arange(n)
    while True:
        low = root.copy()
        near = np.where(hit, root[right][None, :], n).min(1, initial=n)
        low[left] = np.minimum(low[left], near)
        near = np.where(hit, low[left][:, None], n).min(0, initial=n)
        low[right] = np.minimum(low[right], near)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _confirm(width: int, num: int, den: int):
    """Rows (root, a, b, block, cls, text), in order of (root, a, b): a spanning forest of the links between blocks a and
    b (or in a, if they are one). Only one block pair is held at a time."""

    def solve(rows: list[tuple]) -> list[tuple]:
        texts = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(r[5]) for r in rows])))
        values, at, ids = [], [0], []
        for i, j in slices(bounds):
            x, b = shingle_sets(*cut(texts, bounds, i, j), width)
            values.append(x)
            at.extend((b[1:] + at[-1]).tolist())
            ids += [y.tobytes() for y in set_ids(x, b)]
        # another row may share the doc_id, or the same row stand there twice: only one with the class's own set counts
        first: dict[bytes, int] = {}
        for k, r in enumerate(rows):
            if ids[k] == r[4]:
                first.setdefault(r[4], k)
        keep = [first[c] for c in sorted(first)]
        if len(keep) < 2:
            return []
        all_values, at = np.concatenate(values), np.array(at)
        own = np.concatenate([all_values[at[k] : at[k + 1]] for k in keep])
        own_at = np.concatenate(([0], np.cumsum(np.diff(at)[keep])))
        block = np.array([rows[k][3] for k in keep])
        a, b = rows[0][1], rows[0][2]
        left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
        if not len(left) or not len(right):
            return []
        root = _forest(links(own, own_at, left, right, num, den), left, right, len(keep))
        cls = [rows[k][4] for k in keep]
        return [(cls[k], cls[r]) for k, r in enumerate(root.tolist()) if k != r]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def pack() -> pa.RecordBatch:
            u, v = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != r[:3]:
                    out += solve(held)
                    held = []
                held.append(r)
            yield pack()
            out = []
        if held:
            out += solve(held)
        yield pack()

    return run


def _blocks():
    """Blocks that a group of members needs."""
    return F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n_bytes") / BLOCK_BYTES), F.lit(1)).cast("int")


def _stars(shared: DataFrame, info: DataFrame) -> DataFrame:
    """Every class of shared(key, cls, v) against one leader only, the smallest class v of any of its buckets: rows for
    _confirm. A leader's followers are dealt to as many blocks as they need, each with a copy of the leader."""
    star = shared.where("cls <> v").groupBy("cls").agg(F.min("v").alias("root")).join(info, "cls")
    shares = star.groupBy("root").agg(_blocks().alias("nb"))
    followers = star.join(shares, "root").select("root", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int").alias("k"), F.lit(1).alias("side"), "cls", "doc_id")
    leaders = shares.join(info.withColumnRenamed("cls", "root"), "root").select("root", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("k"), F.lit(0).alias("side"), F.col("root").alias("cls"), "doc_id")
    return followers.unionByName(leaders).select("root", (2 * F.col("k")).alias("a"), (2 * F.col("k") + 1).alias("b"), (2 * F.col("k") + F.col("side")).alias("block"), "cls", "doc_id")


def _others(spark: SparkSession, shared: DataFrame, near: DataFrame, info: DataFrame) -> DataFrame:
    """Rows for _confirm that compare all classes of shared(key, cls, v) which share a bucket and aren't in one group yet.

    A class's group is the leader that its leader (or it) was confirmed against. Buckets of one group are done; the
    others connect their groups to clusters, and the classes that stand in them are compared block by block in each
    cluster. Groups that fill a block have blocks of their own, which never meet each other.
    """
    up = near.select(F.col("u").alias("cls"), F.col("v").alias("up"))
    over = near.select(F.col("u").alias("up"), F.col("v").alias("top"))
    group = stored(spark, up.join(over, "up", "left").select("cls", F.coalesce("top", "up").alias("grp")), "groups")
    seen = shared.select("key", "cls").join(group, "cls", "left").withColumn("grp", F.coalesce("grp", "cls"))
    undone = seen.groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("key", "lo")
    touched = stored(spark, seen.join(undone, "key").select("cls", "grp", "lo").distinct(), "touched")
    clusters = components(spark, touched.select(F.col("grp").alias("u"), F.col("lo").alias("v"))).withColumnRenamed("u", "grp")
    rest = stored(spark, touched.select("cls", "grp").distinct().join(clusters, "grp").join(info, "cls"), "rest")
    # blocks are numbered within a cluster: first those of all smaller groups together, then those of each large one
    own = rest.groupBy("root", "grp").agg(_blocks().alias("nb")).select("root", "grp", F.when(F.col("nb") > 1, F.col("grp")).otherwise(F.lit(b"")).alias("own"))
    rest = rest.join(own, ["root", "grp"])
    each = Window.partitionBy("root")
    before = F.sum("nb").over(each.orderBy("own").rowsBetween(Window.unboundedPreceding, -1))
    ranges = rest.groupBy("root", "own").agg(_blocks().alias("nb")).select("root", "own", "nb", F.coalesce(before, F.lit(0)).cast("int").alias("lo"), F.sum("nb").over(each).cast("int").alias("total"))
    ranges = ranges.withColumn("hi", F.when(F.col("own") == F.lit(b""), F.col("lo")).otherwise(F.col("lo") + F.col("nb")))
    placed = rest.join(ranges, ["root", "own"]).withColumn("block", F.col("lo") + F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
    met = placed.select("root", "block", "cls", "doc_id", F.explode(F.expr("filter(sequence(0, total - 1), o -> o < lo or o >= hi)")).alias("o"))
    return met.select("root", F.least("block", "o").alias("a"), F.greatest("block", "o").alias("b"), "block", "cls", "doc_id")


def near_duplicates(spark: SparkSession, docs: DataFrame, num: int = 80, den: int = 100, width: int = 5) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) for every row of docs(doc_id, text, ...); text_key is the 64-bit
    hash of the text, which tells rows apart that share a doc_id.

    Two documents are linked if den * |A and B| >= num * |A or B| for their sets of distinct width-word shingles
    (A-Z in lower case; words are what stands between spaces and the controls 9 to 13). component_id is the
    smallest doc_id reachable over links.

    1. One pass makes set ids and half keys; equal sets become one class, so copies never meet again.
    2. Only classes that share some left and some right half key with another take part in the table keys. Each is
       confirmed on full sets against one leader, the smallest class of its buckets: one comparison a class, which puts
       near copies of one text together.
    3. Buckets whose classes are together by then are done. The classes of the others are compared, where not together
       yet, block by block (bounded memory; large clusters spread over tasks). Only a spanning forest of the links leaves
       a task. Every two classes that share a table are thus compared or already connected.

    Null or empty text, or text without words: empty set, linked with nothing. Rows with a null doc_id count as
    documents but can't name a component that has another id. Rows that share a doc_id are documents of their own, each
    with its own text's component; those whose doc_id is their component's are all kept. Ties can't occur: ids decide. Columns other than doc_id and text are ignored.
    """
    base = stored(spark, docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(_sketches(width), "doc_id long, text_key long, n_shingles long, n_bytes long, cls binary, halves array<long>"), "sketches")
    classes = base.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("n_bytes", "halves")).alias("x")).select("cls", "doc_id", "x.n_bytes", "x.halves")
    classes = stored(spark, classes, "classes")
    half = classes.select("cls", F.posexplode("halves").alias("g", "h"))
    shared = half.groupBy("g", "h").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    alive = half.join(shared, ["g", "h"]).groupBy("cls").agg(F.max(F.col("g") < SIDE).alias("l"), F.max(F.col("g") >= SIDE).alias("r")).where("l and r").select("cls")
    left, right = F.slice("halves", 1, SIDE), F.slice("halves", SIDE + 1, SIDE)
    sides = stored(spark, classes.join(alive, "cls").select("cls", "doc_id", "n_bytes", left.alias("l"), right.alias("rs")), "sides")
    info = sides.select("cls", "doc_id", "n_bytes")
    keys = sides.select("cls", F.explode("l").alias("l"), "rs").select("cls", F.explode("rs").alias("r"), "l").select("cls", F.xxhash64("l", "r").alias("key"))
    least = keys.groupBy("key").agg(F.min("cls").alias("v"), F.count("*").alias("n")).where("n > 1").select("key", "v")
    shared = stored(spark, keys.join(least, "key").select("key", "cls", "v"), "shared")  # few keys have two classes
    text = docs.select(F.col("doc_id").alias("d"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    # whole texts are shuffled once; only those of classes that may have a partner are read again
    text = stored(spark, info.select("cls", "doc_id").join(text, F.col("doc_id").eqNullSafe(F.col("d"))).select("cls", "text"), "texts")

    def confirmed(rows: DataFrame) -> DataFrame:
        """(u, v): links that connect what is linked in rows(root, a, b, block, cls, doc_id)."""
        held = rows.join(text, "cls").select("root", "a", "b", "block", "cls", "text")
        held = held.repartition(partitions(spark), "root", "a", "b").sortWithinPartitions("root", "a", "b")
        return stored(spark, held.mapInArrow(_confirm(width, num, den), "u binary, v binary"), "links")

    near = confirmed(stored(spark, _stars(shared, info), "stars"))
    found = confirmed(_others(spark, shared, near, info))
    roots = components(spark, near.unionByName(found))
    grown = base.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).join(roots.withColumnRenamed("u", "cls"), "cls", "left").where("n > 1 or root is not null").withColumn("root", F.coalesce("root", "cls"))
    lowest = grown.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grown.join(lowest, "root").select("cls", "component_id")
    return base.select("doc_id", "text_key", "n_shingles", "cls").join(named, "cls", "left").select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(spark: SparkSession, docs: DataFrame, num: int = 80, den: int = 100, width: int = 5) -> DataFrame:
    """The rows of docs, all columns, that near_duplicates() keeps: of each group those with its smallest doc_id. Rows
    without words are in no group and stay. Rows are told apart by doc_id and text."""
    key, code, mine = fresh(docs, "_doc", "_code", "_mine")
    gone = near_duplicates(spark, docs, num, den, width).where("not kept").select(F.col("doc_id").alias(key), F.col("text_key").alias(code)).distinct()
    marked = docs.withColumn(mine, F.xxhash64("text"))
    return marked.join(gone, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(mine) == F.col(code)), "left_anti").drop(mine)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), num=85).drop("text_key")


OP2_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, case when len(ws) < 5 then array_to_string(ws, ' ') else array_to_string(ws[i:i+4], ' ') end as sh
      from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)),
r as (select doc_id as u, doc_id as v from w union select r.u, e.y from r join e on e.x = r.v)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.v) as component_id, w.doc_id = min(r.v) as kept
from w left join n using (doc_id) join r on r.u = w.doc_id group by w.doc_id, n.n
"""
