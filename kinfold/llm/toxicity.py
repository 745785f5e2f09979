"""Toxicity: a learned lexicon matched by Levenshtein automata, with context windows that tell quotation from abuse."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import blob, cut, slices, stored, table

#: At most so many labelled rows are learnt from (those with the smallest hash), and so many terms kept.
SAMPLE_ROWS, MAX_TERMS = 12_000, 200
#: Toxic texts that have a term at least, how many times likelier it is there, and words that share a stem.
MIN_TEXTS, MIN_ODDS, MIN_KINDS = 5, 20.0, 3
#: Stems are prefixes of these lengths; terms from FUZZY letters on may have one letter wrong.
STEMS, FUZZY = (4, 5, 6, 7, 8), 5
#: Words on either side of a term that make up its context.
CONTEXT = 5
THRESHOLD = 0.3
REPORTING = "said says wrote called calls quote quoted word term phrase dit mot terme appelé sagte wort zitat nannte dijo palabra término llamó".split()
ADDRESSING = "you your youre u tu toi vous ton du dich dein euch ihr te ti usted vosotros".split()
QUOTES = "\"“”„«»‘’‹›"
_FOLD = 0x2000


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code points below _FOLD to the lower-case letter, 0 for what is not a letter; 1 for letters above. Accents
    stay: a term and an innocent word may differ in nothing else."""
    out = np.zeros(_FOLD + 1, np.uint32)
    for c in range(_FOLD):
        s = chr(c).lower()[:1]
        if unicodedata.category(chr(c))[0] in "LM" and ord(s) < _FOLD:
            out[c] = ord(s)
    out[_FOLD] = 1
    return out


@dataclass
class Tokens:
    """All letter runs of a slice of documents, folded; at[d] is the first token of document d."""

    codes: np.ndarray
    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray

    def word(self, k: int) -> str:
        return "".join(map(chr, self.codes[self.start[k] : self.end[k]].tolist()))


def tokens(chars: np.ndarray, bounds: np.ndarray) -> Tokens:
    raw = np.frombuffer(chars.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate(([0], np.cumsum((chars & 0xC0) != 0x80)))[bounds]
    codes = fold_table()[np.minimum(raw, _FOLD)]
    letter = codes > 0
    first, last = letter.copy(), letter.copy()
    if len(raw):
        first[1:] &= ~letter[:-1]
        last[:-1] &= ~letter[1:]
        b = begins[:-1][begins[:-1] < len(raw)]
        first[b] = letter[b]
        b = b[b > 0] - 1
        last[b] = letter[b]
    start = np.flatnonzero(first)
    return Tokens(codes, raw, start, np.flatnonzero(last) + 1, np.searchsorted(start, begins))


class Automaton:
    """The deterministic automaton of a lexicon trie intersected with Levenshtein automata of its terms.

    A term ending in * is a stem, which any ending may follow. States are sets of (trie node, edits); run() moves
    all tokens at once, and those that no term can match any more drop out.
    """

    def __init__(self, terms: list[str]) -> None:
        children: list[dict[str, int]] = [{}]
        final: dict[int, tuple[bool, int]] = {}
        reach = [0]
        for t in sorted(terms):
            word, stem = t.rstrip("*"), t.endswith("*")
            most = int(len(word) >= FUZZY and not stem or len(word) > FUZZY)
            node = 0
            reach[0] = max(reach[0], most)
            for c in word:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    reach.append(0)
                node = children[node][c]
                reach[node] = max(reach[node], most)
            final[node] = stem or final.get(node, (False, 0))[0], most
        letters = sorted({c for x in children for c in x})
        self.classes = np.zeros(_FOLD + 1, np.int32)
        for i, c in enumerate(letters):
            self.classes[ord(c)] = i + 1

        def closed(nodes: dict[int, int]) -> dict[int, int]:
            todo = list(nodes.items())
            while todo:
                n, e = todo.pop()
                for m in children[n].values():
                    if e + 1 <= reach[m] and nodes.get(m, 9) > e + 1:
                        nodes[m] = e + 1
                        todo.append((m, e + 1))
            return nodes

        def key(nodes: dict[int, int], best: int) -> tuple:
            for n, e in nodes.items():
                if n in final and final[n][0] and e <= final[n][1]:
                    best = min(best, e)
            return (frozenset(), 0) if best == 0 else (frozenset(nodes.items()), best)

        begin = key(closed({0: 0}), 2)
        ids, todo, rows, accept = {(frozenset(), 2): 0, begin: 1}, [(frozenset(), 2), begin], [], []
        for state in todo:
            nodes, best = state
            accept.append(min([best, *(e for n, e in nodes if n in final and e <= final[n][1])]))
            row = []
            for c in ["", *letters]:
                new: dict[int, int] = {}
                for n, e in nodes:
                    for d, m in children[n].items():
                        cost = e + (d != c)
                        if cost <= reach[m]:
                            new[m] = min(new.get(m, 9), cost)
                    if e + 1 <= reach[n]:
                        new[n] = min(new.get(n, 9), e + 1)
                to = key(closed(new), best)
                if to not in ids:
                    ids[to] = len(ids)
                    todo.append(to)
                row.append(ids[to])
            rows.append(row)
        self.next = np.array(rows, np.int32)
        self.accept = np.array(accept, np.int8)
        #: States in which nothing can change any more.
        self.fixed = (self.next == np.arange(len(rows))[:, None]).all(1)

    def run(self, t: Tokens) -> np.ndarray:
        """Edits to the nearest term of each token: 0, 1, or 2 for none."""
        state = np.ones(len(t.start), np.int32)
        classes = self.classes[np.minimum(t.codes, _FOLD)]
        live, size, k = np.arange(len(state)), t.end - t.start, 0
        while len(live):
            live = live[size[live] > k]
            state[live] = now = self.next[state[live], classes[t.start[live] + k]]
            live = live[~self.fixed[now]]
            k += 1
        return self.accept[state]


def context(t: Tokens, hits: np.ndarray) -> np.ndarray:
    """Whether each hit is quoted: quotation marks and reporting words around it outweigh words that address a reader."""
    quoted = np.zeros(len(hits), bool)
    doc = np.searchsorted(t.at, hits, "right") - 1
    marks = np.array([ord(c) for c in QUOTES], np.uint32)
    for n, (k, d) in enumerate(zip(hits.tolist(), doc.tolist())):
        lo, hi = max(int(t.at[d]), k - CONTEXT), min(int(t.at[d + 1]), k + CONTEXT + 1)
        before, after = t.raw[t.start[lo] : t.start[k]], t.raw[t.end[k] : t.end[hi - 1]]
        score = 2.0 * bool(np.isin(before, marks).any() and np.isin(after, marks).any())
        if score or len(REPORTING):
            near = [t.word(m) for m in range(lo, hi) if m != k]
            score += sum(w in _REPORTING for w in near) - sum(w in _ADDRESSING for w in near)
        quoted[n] = score > 0
    return quoted


_REPORTING, _ADDRESSING = frozenset(REPORTING), frozenset(ADDRESSING)
N_FEATURES = 6


def features(auto: Automaton, chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row for each document: log counts of exact and misspelled terms, plain and quoted; any; per hundred words."""
    t = tokens(chars, bounds)
    edits = auto.run(t)
    hits = np.flatnonzero(edits < 2)
    doc = np.searchsorted(t.at, hits, "right") - 1
    quoted, exact = context(t, hits), edits[hits] == 0
    count = lambda which: np.bincount(doc[which], minlength=len(bounds) - 1).astype(float)
    plain = count(exact & ~quoted)
    per = np.minimum(plain / np.maximum(np.diff(t.at), 1) * 100, 10)
    return np.column_stack([np.log1p(plain), np.log1p(count(exact & quoted)), np.log1p(count(~exact & ~quoted)), np.log1p(count(~exact & quoted)), plain > 0, per])


@dataclass
class Model:
    terms: list[str]
    automaton: Automaton
    weights: np.ndarray

    def score(self, chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        x = features(self.automaton, chars, bounds)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, toxic texts, other texts) of each batch of (text, toxic). Units are words, stems with a star, and, behind an equals
    sign and with toxic texts only, all words that have a stem."""
    for batch in batches:
        chars, bounds = blob(batch.column(0))
        label = batch.column(1).to_numpy(zero_copy_only=False)
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for i, j in slices(bounds):
            t = tokens(*cut(chars, bounds, i, j))
            for d in range(j - i):
                found = {t.word(k) for k in range(t.at[d], t.at[d + 1])}
                units = {w for w in found if 3 < len(w) < 25} | {w[:n] + "*" for w in found for n in STEMS if len(w) > n}
                if label[i + d]:
                    units |= {"=" + w for w in found if len(w) > STEMS[0]}
                counts[int(label[i + d])].update(units)
        units = list(counts[1].keys() | counts[0].keys())
        yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array([counts[1][u] for u in units], pa.int64()), pa.array([counts[0][u] for u in units], pa.int64())], ["unit", "pos", "neg"])


def _rows(auto: Automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, bounds = blob(batch.column(0))
            for i, j in slices(bounds):
                x = features(auto, *cut(chars, bounds, i, j))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel())), batch.column(1).slice(i, j - i)], ["x", "toxic"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of least penalised loss, by Newton's method. A full step can overshoot where classes are all but separable, so it
    is halved until the loss falls; the loss is convex, so this comes to its least."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    w[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    loss = lambda w: float(np.logaddexp(0, x @ w).sum() - y @ (x @ w) + penalty @ (w * w) / 2)
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        while (then := loss(w + step)) > now and np.abs(step).max() > 1e-12:
            step /= 2
        if then > now:
            break
        w, now = w + step, then
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns terms and weights from at most sample_rows labelled documents outside the held-out quarter (bounded,
    so that the sample may be broadcast). Equal texts count once. Without labels the model scores 0.5 or less."""
    some = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    known = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("m")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", F.col("toxic").cast("int").alias("toxic"))
    known = stored(spark, known, "labelled")
    totals = {int(r["toxic"]): r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    units = stored(spark, known.mapInArrow(_units, "unit string, pos long, neg long").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "units")
    # a stem is one that several distinct words of all toxic rows share
    words = units.where(F.col("unit").startswith("=")).select(F.substring("unit", 2, 1 << 30).alias("w"), F.explode(F.array(*[F.lit(n) for n in STEMS])).alias("n")).where(F.length("w") > F.col("n"))
    shared = words.groupBy(F.concat(F.expr("left(w, n)"), F.lit("*")).alias("unit")).agg(F.count("*").alias("kinds")).where(F.col("kinds") >= MIN_KINDS)
    units = units.where(~F.col("unit").startswith("=")).join(shared, "unit", "left").where(~F.col("unit").endswith("*") | F.col("kinds").isNotNull())
    odds = ((F.col("pos") + 0.5) / (pos + 1)) / ((F.col("neg") + 0.5) / (neg + 1))
    found = units.where(F.col("pos") >= MIN_TEXTS).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS).orderBy(F.desc(F.log("odds") * F.sqrt("pos")), "unit").limit(MAX_TERMS).collect()
    chosen = {r["unit"] for r in found}
    terms = sorted(u for u in chosen if not any(u.rstrip("*")[:n] + "*" in chosen for n in STEMS if n < len(u.rstrip("*")) or n == len(u) and not u.endswith("*")))
    auto = Automaton(terms)
    rows = known.mapInArrow(_rows(auto), "x array<double>, toxic int").collect()  # at most sample_rows rows
    weights = _logistic(np.array([r["x"] for r in rows]), np.array([float(r["toxic"]) for r in rows])) if rows else np.array([-1.0, 1, 0, 0.5, 0, 1, 0])
    return Model(terms, auto, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of docs(doc_id, text, ...), from the text alone. Null or empty text has no
    terms and gets the model's base score; equal texts get equal scores; null doc_ids, repeated rows pass through;
    other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, bounds = blob(batch.column(1))
            for i, j in slices(bounds):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(model.score(*cut(chars, bounds, i, j)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores below threshold, or which have none (null or white space)."""
    model = fit(spark, docs, labels)

    @F.pandas_udf("double")
    def scored(text):
        chars, bounds = blob(pa.Array.from_pandas(text, type=pa.string()))
        parts = [model.score(*cut(chars, bounds, i, j)) for i, j in slices(bounds)]
        import pandas as pd

        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.where(F.coalesce(F.trim("text"), F.lit("")).rlike(r"^\s*$") | (scored("text") < threshold))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(spark, docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
