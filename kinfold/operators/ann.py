"""Vector search joins and text embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.similarity import cosine

BUCKETS, MAX_GRAMS, DIM = 1 << 17, 320, 128
#: Centroids that may be broadcast, and queries of an exact search in one block.
MAX_CENTROIDS, BLOCK = 65_536, 2048
#: Items of a leaf that one task meets with a block of queries.
LEAF_ROWS = 65_536


def unit(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q_id").orderBy(F.desc("cos"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class _Nearest:
    """The k nearest items of some query vectors, over batches of items; of equally near ones those with smaller ids. A matrix product
    finds what may be near enough; its cosines are summed again one by one, as those of equal vectors may differ in a product."""

    def __init__(self, ids: list[int], vectors: list, k: int, cutoff: float | None, exclude_self: bool) -> None:
        q = np.array(vectors, np.float64).reshape(len(ids), -1)
        self.q, self.ids, self.k, self.cutoff, self.exclude_self = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300), np.array(ids, np.int64), k, cutoff, exclude_self
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)

    def add(self, ids: list[int], vectors: list) -> None:
        for lo in range(0, len(ids), BLOCK):
            own = np.array(ids[lo : lo + BLOCK], np.int64)
            x = np.array(vectors[lo : lo + BLOCK], np.float64).reshape(len(own), -1)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            cos = self.q @ x.T
            if self.exclude_self:
                cos[self.ids[:, None] == own[None, :]] = -np.inf
            for i, c in enumerate(cos):
                least = -np.inf if len(c) <= self.k else np.partition(c, len(c) - self.k)[len(c) - self.k] - 1e-9
                keep = np.flatnonzero((c >= least) & (c > -np.inf))
                both, names = np.concatenate((self.held[i][0], (x[keep] * self.q[i]).sum(1))), np.concatenate((self.held[i][1], own[keep]))
                if len(both) > self.k:
                    keep = np.lexsort((names, -both))[: self.k]
                    both, names = both[keep], names[keep]
                self.held[i] = both, names

    def rows(self) -> pa.RecordBatch:
        cos = np.concatenate([x for x, _ in self.held]) if self.held else np.zeros(0)
        names = np.concatenate([x for _, x in self.held]) if self.held else np.zeros(0, np.int64)
        q = np.repeat(self.ids, [len(x) for x, _ in self.held])
        keep = np.ones(len(cos), bool) if self.cutoff is None else cos >= self.cutoff
        return pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(names[keep]), pa.array(cos[keep])], ["q_id", "id", "cos"])


def _blocks(k: int, cutoff: float | None, exclude_self: bool):
    """Rows (key columns..., side, id, vec), sorted by all but the last two, to the k nearest items (side 1) of each query (side 0) in
    each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, near, ids, vectors = None, None, [], []
        for batch in batches:
            for *group, side, name, vec in zip(*(c.to_pylist() for c in batch.columns)):
                if group != key:
                    if near is not None:
                        near.add(ids, vectors)
                        yield near.rows()
                    key, near, ids, vectors = group, None, [], []
                if side and near is None:  # the queries of a group come first
                    near, ids, vectors = _Nearest(ids, vectors, k, cutoff, exclude_self), [], []
                ids.append(name)
                vectors.append(vec)
                if side and len(ids) >= BLOCK:
                    near.add(ids, vectors)
                    ids, vectors = [], []
        if near is not None:
            near.add(ids, vectors)
            yield near.rows()

    return run


def exact_knn(queries: DataFrame, items: DataFrame, k: int, cutoff: float | None = None, exclude_self: bool = True, block: int = BLOCK) -> DataFrame:
    """(q_id, id, cos, rank): for each of queries(id, vec) its k nearest of items(id, vec) by cosine, exactly.

    Up to block queries are handed to every task that reads items. More are cut into blocks of about that many, as are the items,
    and each block of queries meets each block of items in a group of its own: nothing but a count reaches the driver. A
    task keeps k of each query, so what is shuffled after it doesn't grow with the number of items in a task.
    """
    q = queries.select(F.col("id").cast("long").alias("id"), "vec").where("vec is not null")
    x = items.select(F.col("id").cast("long").alias("id"), "vec").where("vec is not null")
    n = q.count()
    out = "q_id long, id long, cos double"
    if n <= block:
        held = q.toArrow()  # at most block rows
        ids, vectors = held.column(0).to_pylist(), held.column(1).to_pylist()

        def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = _Nearest(ids, vectors, k, cutoff, exclude_self)
            for batch in batches:
                near.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield near.rows()

        return top_k(x.mapInArrow(few, out), k)

    tasks = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_q = -(-n // block)
    n_x = max(1, -(-tasks // n_q))
    dealt = lambda df, own, other, side, m, of: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(of - 1)))).select("qb", "xb", F.lit(side).alias("side"), "id", "vec")
    both = dealt(q, "qb", "xb", 0, n_q, n_x).unionByName(dealt(x, "xb", "qb", 1, n_x, n_q))
    return top_k(both.repartition(max(tasks, n_q * n_x), "qb", "xb").sortWithinPartitions("qb", "xb", "side").mapInArrow(_blocks(k, cutoff, exclude_self), out), k)


def kmeans(items: DataFrame, k: int, iterations: int = 6, seed: int = 5):
    """Spherical k-means over items(vec)."""
    return KMeans(k=k, maxIter=iterations, seed=seed, distanceMeasure="cosine", featuresCol="v", predictionCol="leaf").fit(items.select(array_to_vector(unit(F.col("vec")).cast("array<double>")).alias("v")))


def assign(items: DataFrame, centroids: np.ndarray, probes: int = 1) -> DataFrame:
    """items with leaf, one row for each of the probes nearest centroids (by cosine, ties by number)."""
    if len(centroids) > MAX_CENTROIDS:
        raise ValueError("too many centroids to hand to every task")
    c = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-300)

    @F.pandas_udf("array<int>")
    def nearest(vec):
        import pandas as pd

        x = np.array(vec.tolist(), np.float64).reshape(len(vec), -1)
        sim = x @ c.T
        return pd.Series(list(np.argsort(-sim, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return items.withColumn("leaf", F.explode(nearest(F.col("vec"))))


class IVF:
    """A two-level inverted file: cells of k1 centroids, each with leaves of its own; leaf ids are join keys."""

    def __init__(self, top: np.ndarray, leaves: list[np.ndarray]) -> None:
        self.top = top
        self.start = np.concatenate(([0], np.cumsum([len(x) for x in leaves])))
        self.leaves = np.concatenate(leaves)
        if len(self.leaves) > MAX_CENTROIDS:
            raise ValueError("too many leaves to hand to every task")
        self.norm = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def probe(self, items: DataFrame, n1: int, n2: int) -> DataFrame:
        """items with leaf: the n2 nearest leaves in each of the n1 nearest cells."""
        top, leaves, start = self.norm(self.top), self.norm(self.leaves), self.start

        @F.pandas_udf("array<int>")
        def near(vec):
            import pandas as pd

            x = np.array(vec.tolist(), np.float64).reshape(len(vec), -1)
            cells = np.argsort(-(x @ top.T), axis=1, kind="stable")[:, :n1]
            out: list[list[int]] = [[] for _ in range(len(x))]
            for c in np.unique(cells).tolist():  # leaves are compared with the vectors that probe their cell only
                rows = np.flatnonzero((cells == c).any(1))
                best = start[c] + np.argsort(-(x[rows] @ leaves[start[c] : start[c + 1]].T), axis=1, kind="stable")[:, :n2]
                for i, own in zip(rows.tolist(), best.tolist()):
                    out[i] += own
            return pd.Series([np.array(v, np.int32) for v in out])

        return items.withColumn("leaf", F.explode(near(F.col("vec"))))


def build_ivf(items: DataFrame, k1: int = 1024, k2: int = 64, sample: int = 200_000, iterations: tuple[int, int] = (6, 3), seed: int = 5) -> IVF:
    """Fitted on all rows or, of more than sample, on about so many, those with the smallest hash (a bounded, documented sample); the index then takes every row. A cell of n sampled
    rows gets min(k2, max(1, n / 8)) leaves."""
    some = items.where("vec is not null").select("id", "vec")
    n = some.count()
    if n > sample:  # by a bound on the hash: a sort with a limit would gather the sample on the driver
        some = some.where(F.xxhash64("id") < F.lit(-(1 << 63) + (1 << 64) * sample // n))
    some = some.repartition(items.sparkSession.sparkContext.defaultParallelism, "id").persist(StorageLevel.MEMORY_AND_DISK)
    top = np.array(kmeans(some, min(k1, max(1, some.count() // 8)), iterations[0], seed).clusterCenters())

    def cell(key, pdf):
        import pandas as pd

        x = np.array(pdf["vec"].tolist(), np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        k = min(k2, max(1, len(x) // 8))
        c = x[np.linspace(0, len(x) - 1, k).astype(int)]
        for _ in range(iterations[1]):
            own = np.argmax(x @ c.T, axis=1)
            for j in range(k):
                c[j] = x[own == j].mean(0) if (own == j).any() else x[(j * 7919) % len(x)]
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
        return pd.DataFrame({"leaf": key[0], "c": list(c.tolist())})

    rows = assign(some, top).groupBy("leaf").applyInPandas(cell, "leaf int, c array<double>").collect()  # k1 * k2 at most
    some.unpersist()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["leaf"], []).append(r["c"])
    return IVF(top, [np.array(by.get(k) or [top[k].tolist()]) for k in range(len(top))])


def choose_probes(queries: DataFrame, items: DataFrame, index: IVF, k: int = 50, least: float = 0.9, sample: int = 200, cutoff: float | None = None) -> tuple[tuple[int, int], float]:
    """(probes, recall): the first of (2, 4), (4, 8), (8, 16), ... at which ivf_join() finds at least this share of the exact k
    nearest of a sample of queries, those with the smallest hash (bounded, so that the exact search is cheap). All
    leaves probed is the last step, which is exact."""
    some = queries.select("id", "vec").where("vec is not null").orderBy(F.xxhash64("id"), "id").limit(sample)
    exact = {(r["q_id"], r["id"]) for r in exact_knn(some, items, k, cutoff).select("q_id", "id").collect()}  # sample * k rows
    cells, leaves = len(index.top), int(np.diff(index.start).max())
    probes = (2, 4)
    while True:
        probes = (min(probes[0], cells), min(probes[1], leaves))
        found = {(r["q_id"], r["id"]) for r in ivf_join(some, items, index, k, probes, cutoff).select("q_id", "id").collect()}
        recall = len(found & exact) / len(exact) if exact else 1.0
        if recall >= least or probes == (cells, leaves):
            return probes, recall
        probes = (probes[0] * 2, probes[1] * 2)


def ivf_join(queries: DataFrame, items: DataFrame, index: IVF, k: int = 50, probes: tuple[int, int] = (2, 4), cutoff: float | None = None, exclude_self: bool = True, country: str | None = None) -> DataFrame:
    """(q_id, id, cos, rank): queries probe n1 x n2 leaves, queries and items of a leaf meet in groups (blocks of a large
    leaf in several), and exact cosines rank them; no pair is a row. country names a column that must agree, if any. What the default probes find depends on the index; choose_probes() measures it."""
    extra = [country] if country else []
    keys = ["leaf", *([country] if country else [])]
    some = lambda df: df.select(F.col("id").cast("long").alias("id"), "vec", *keys[1:]).where("vec is not null")
    q, x = index.probe(some(queries), *probes), index.probe(some(items), 1, 1)
    count = lambda df, n, of: df.groupBy(*keys).agg(F.ceil(F.count("*") / of).cast("int").alias(n))
    sizes = count(q, "qn", BLOCK).join(count(x, "xn", LEAF_ROWS), keys)
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(sizes, keys).select(*keys, place("qn").alias("qb"), every("xn").alias("xb"), F.lit(0).alias("side"), "id", "vec")
    x = x.join(sizes, keys).select(*keys, every("qn").alias("qb"), place("xn").alias("xb"), F.lit(1).alias("side"), "id", "vec")
    dealt = q.unionByName(x).repartition(*keys, "qb", "xb").sortWithinPartitions(*keys, "qb", "xb", "side")
    return top_k(dealt.mapInArrow(_blocks(k, cutoff, exclude_self), "q_id long, id long, cos double"), k)


def hard_negatives(neighbours: DataFrame, gold: DataFrame, per_anchor: int = 8) -> DataFrame:
    """(q_id, id): each anchor's nearest neighbours that aren't its matches; gold is (q_id, id)."""
    w = Window.partitionBy("q_id").orderBy("rank")
    left = neighbours.join(gold.select("q_id", "id"), ["q_id", "id"], "left_anti")
    return left.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_anchor).select("q_id", "id", "rank")


def recall_at(neighbours: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (10, 25, 50, 100)) -> DataFrame:
    """(k, macro_recall, any_hit): per anchor with gold, then averaged."""
    g = gold.select("q_id", "id").distinct()
    hit = g.join(neighbours.select("q_id", "id", "rank"), ["q_id", "id"], "left")
    rows = hit.select("q_id", "rank", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    per = rows.groupBy("k", "q_id").agg(F.avg(F.when(F.col("rank") <= F.col("k"), 1.0).otherwise(0.0)).alias("r"))
    return per.groupBy("k").agg(F.avg("r").alias("macro_recall"), F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("any_hit"))


# ---------------------------------------------------------------- text embeddings


def grams(text: Column, most: int | None = MAX_GRAMS) -> Column:
    """Character runs of 3 and 4, words, and pairs of words of a text, in this order and with a mark for their kind; the first
    of them, or all."""
    none = F.array().cast("array<string>")
    if most is not None:  # runs of 3 come first, so what is behind so many characters can't be among the first
        text = F.substring(text, 1, most + 3)
        n = F.length(text)
        chars = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.concat(F.lit(f"{k}:"), F.substring(text, i, F.lit(k))))).otherwise(none)
    else:  # characters are split once and bound: a place in a string is found by counting from its start
        run = lambda c, k: F.when(F.size(c) >= k, F.transform(F.sequence(F.lit(0), F.size(c) - k), lambda i: F.concat(F.lit(f"{k}:"), *[F.get(c, i + j) for j in range(k)]))).otherwise(none)
        chars = lambda k: F.transform(F.array(F.split(text, "")), lambda c: run(c, k))[0]
    words = F.filter(F.split(text, " "), lambda w: w != "")
    one = F.transform(words, lambda w: F.concat(F.lit("w:"), w))
    pairs = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(F.lit("b:"), F.get(w, i), F.lit(" "), F.get(w, i + 1)))).otherwise(none)
    two = pairs(words) if most is not None else F.transform(F.array(words), pairs)[0]
    found = F.concat(chars(3), chars(4), one, two)
    return found if most is None else F.slice(found, 1, most)


def bucketed(g: Column, buckets: int = BUCKETS) -> Column:
    return F.transform(g, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))


def inverse_frequency(texts: DataFrame, column: str = "buckets") -> DataFrame:
    """(bucket, idf): log1p(n / (1 + df)), df being the records that have the bucket."""
    n = texts.agg(F.count("*").alias("n"))
    df = texts.select(F.explode(F.array_distinct(column)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("bucket", F.log1p(F.col("n") / (1 + F.col("df"))).alias("idf"))  # one row


class Encoder:
    """Hashed grams, weighted by idf, summed over rows of a matrix and scaled to length 1. Untrained, the matrix is a random
    projection, which keeps cosines in expectation."""

    def __init__(self, buckets: int = BUCKETS, dim: int = DIM, seed: int = 7, weights: np.ndarray | None = None) -> None:
        self.buckets, self.dim = buckets, dim
        self.w = weights if weights is not None else np.random.default_rng(seed).normal(0, dim**-0.5, (buckets, dim)).astype(np.float32)
        self.idf = np.ones(buckets, np.float32)

    def fit_idf(self, texts: DataFrame, column: str = "text") -> Encoder:
        rows = inverse_frequency(texts.select(bucketed(grams(F.col(column)), self.buckets).alias("buckets"))).collect()  # at most buckets rows
        for r in rows:
            self.idf[r["bucket"]] = r["idf"]
        return self

    def bag(self, ids: np.ndarray) -> np.ndarray:
        v = (self.w[ids] * self.idf[ids][:, None]).sum(0)
        n = np.linalg.norm(v)
        return v / n if n > 0 else v

    def embed(self, texts: DataFrame, column: str = "text") -> DataFrame:
        """texts with vec. The matrix has a fixed size and is broadcast once."""
        held = texts.sparkSession.sparkContext.broadcast((self.w, self.idf))

        @F.pandas_udf("array<float>")
        def bag(ids):
            import pandas as pd

            e = Encoder.__new__(Encoder)
            e.w, e.idf = held.value
            return pd.Series([e.bag(np.asarray(x, np.int64)) if x is not None and len(x) else np.zeros(e.w.shape[1], np.float32) for x in ids])

        return texts.withColumn("vec", bag(bucketed(grams(F.col(column)), self.buckets)))

    def train_step(self, anchors: list[np.ndarray], positives: list[np.ndarray], negatives: list[list[np.ndarray]], rate: float = 0.05, temperature: float = 0.07) -> float:
        """One step down the contrastive loss of anchors against their positive, their negatives and the other positives of the
        batch; a mini-batch of bag indices, on the driver. Returns the mean loss before the step."""
        a = np.array([self.bag(x) for x in anchors], np.float64)
        flat = positives + [x for n in negatives for x in n]
        c = np.array([self.bag(x) for x in flat], np.float64)
        logits = a @ c.T / temperature
        at = len(positives)
        for i, n in enumerate(negatives):  # other anchors' negatives are out
            logits[i, len(positives) : at], logits[i, at + len(n) :] = -np.inf, -np.inf
            at += len(n)
        m = logits.max(1, keepdims=True)
        p = np.exp(logits - m)
        total = p.sum(1, keepdims=True)
        loss = float(np.mean(m[:, 0] + np.log(total[:, 0]) - logits[np.arange(len(a)), np.arange(len(a))]))
        p /= total
        p[np.arange(len(a)), np.arange(len(a))] -= 1
        p /= len(a) * temperature
        for grad, unit_v, bags in ((p @ c, a, anchors), (p.T @ a, c, flat)):
            for g, u, ids in zip(grad, unit_v, bags):
                raw = np.linalg.norm((self.w[ids] * self.idf[ids][:, None]).sum(0)) or 1.0
                d = (g - u * (g @ u)) / raw  # through the scaling to length 1
                np.add.at(self.w, ids, (-rate * self.idf[ids][:, None] * d).astype(np.float32))
        return loss

    def save(self, path: str) -> None:
        np.savez_compressed(path, w=self.w, idf=self.idf)

    @staticmethod
    def load(path: str) -> Encoder:
        d = np.load(path)
        e = Encoder(*d["w"].shape, weights=d["w"])
        e.idf = d["idf"]
        return e
