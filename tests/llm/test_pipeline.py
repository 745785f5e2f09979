"""The pipeline's stages, each held against what its input demands."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from kinfold.llm import suffixes
from kinfold.llm.common import stored, table

from test_operators import brute_lines, shingles

TOP = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = table(spark, TOP, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        new = stored(spark, f(spark, docs, TOP), name)
        out.append((name, docs, new))
        docs = new
    return out


def test_stages_return_documents(kept):
    assert [n for n, *_ in kept] == ["toxicity", "line_dedup", "near_dedup", "suffix_dedup", "packing"]
    for _, before, after in kept[:-1]:
        assert after.columns == corpus_pipeline.COLUMNS and after.schema == before.schema
        ids = {r["doc_id"] for r in before.select("doc_id").collect()}
        assert {r["doc_id"] for r in after.select("doc_id").collect()} <= ids


def test_clean_documents_stay(spark, kept):
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, TOP, "labels").collect()}
    _, before, after = kept[0]
    gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()}
    assert sum(labels.get(d) == 0 for d in gone) <= 1


def test_no_near_duplicates_remain(spark, kept):
    from kinfold.llm import minhash

    assert minhash.near_duplicates(spark, kept[2][2]).where("not kept").count() == 0
    assert kept[1][2].count() == kept[1][1].count()


def covered(rows, size):
    """Which places of each row (a sequence) are covered by a run of size that also starts at another place of any row."""
    seen = Counter(tuple(r[i : i + size]) for r in rows for i in range(len(r) - size + 1))
    for r in rows:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - size + 1):
            if seen[tuple(r[i : i + size])] > 1:
                gone[i : i + size] = True
        yield gone


def brute_cut(texts):
    """What the suffix stage leaves of each text: bytes outside of repeats of 400 bytes and outside of runs of 51 repeated words."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 400] for t in data for i in range(len(t) - 399))
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in data]
    runs = covered([[t[a:b] for a, b in own] for t, own in zip(data, spans)], corpus_pipeline.PASSAGE_WORDS)
    for text, t, own, words in zip(texts, data, spans, runs):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        at = np.flatnonzero(words)
        for k in at.tolist():
            # white space between two covered words goes too
            together = k + 1 < len(words) and words[k + 1]
            gone[own[k][0] : own[k][1]] = True
            if together:
                gone[own[k][1] : own[k + 1][0]] = True
        yield None if text is None else np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")


def test_the_suffix_stage_equals_brute_force(kept):
    _, before, after = kept[3]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    got = {r["doc_id"]: r["text"] for r in after.collect()}
    want = dict(zip([d for d, _ in rows], brute_cut([t for _, t in rows])))
    assert len(got) == len(rows) and got == want and sum(got[d] != t for d, t in rows) > 5


@pytest.mark.parametrize("size", [250, 320, 380, 400, 800, 4000])
def test_planted_passages_go(spark, size):
    """Passages of over 50 words that repeat across documents: op4 catches those of 400 bytes or more, as its contract says; the
    pipeline's stage catches all, and leaves what stands around them."""
    rng = random.Random(size)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    n_words = max(52, size // 7)
    words = [word(max(1, size // n_words - 1)) for _ in range(n_words)]
    passage = " ".join(words)
    passage += word(max(0, size - len(passage)))
    own = [" ".join(word(6) for _ in range(rng.randint(5, 90))) for _ in range(8)]
    rows = [(k, f"{t} . {passage} , {t[::-1]}" if k < 4 else t, "en", "s", 0) for k, t in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.suffix_dedup(spark, docs, TOP).collect()}
    assert all(passage not in got[k] and passage[20:-20] not in got[k] for k in range(4)) and all(got[k] == own[k] for k in range(4, 8))
    assert all(got[k].startswith(own[k][:-4]) and got[k].endswith(own[k][::-1][4:]) for k in range(4))
    gone = {r["doc_id"]: r["n_removed"] for r in suffixes.remove_repeats(spark, docs).collect()}
    caught = size >= suffixes.LENGTH
    assert [gone[k] > 0 for k in range(8)] == [caught] * 4 + [False] * 4
    assert not caught or all(gone[k] >= len(passage) for k in range(4))


def test_op4_tells_passages_under_400_bytes(spark, tmp_path):
    """Besides its contract's columns, op4 has the passages of over 50 words, however short, and the text without them."""
    rng = random.Random(11)
    words = lambda n, k=5: " ".join("".join(rng.choice("abcdefgh\u00e4") for _ in range(k)) for _ in range(n))
    passage, fifty, long = words(51), words(50), words(120)
    assert len(passage.encode()) < suffixes.LENGTH
    texts = [f"{words(30)} {passage} {words(9)}", f"{words(20)}\n{passage.replace(' ', '  ', 5)}", f"{words(8)} {fifty} {words(70)}", f"{fifty} {words(4)}", f"{long} {words(6)}", f"{words(6)}{long}", words(200), None, "", "x", f"{long} {words(3)} {passage}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in suffixes.op4_suffix_array_dedup(spark, str(tmp_path)).collect()}
    data = [(x or "").encode() for x in texts]
    assert [got[k]["n_passages"] for k in range(len(texts))] == [1, 1, 0, 0, 1, 1, 0, 0, 0, 0, 2]
    assert [got[k]["n_passage_bytes"] for k in (0, 1, 2)] == [len(passage.encode()), len(passage.encode()) + 5, 0]
    assert [got[k]["text"] for k in range(len(texts))] == [x or "" for x in brute_cut(texts)]
    assert [got[k]["n_bytes"] for k in range(len(texts))] == [len(x) for x in data]
    assert [got[k]["n_removed"] > 0 for k in range(len(texts))] == [k in (4, 5, 10) for k in range(len(texts))]
    assert all(got[k]["kept_sha256"] == hashlib.sha256(data[k]).hexdigest() for k in range(len(texts)) if k not in (4, 5, 10))


def test_rows_that_share_an_id_go_by_themselves(spark):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))
    line, x, y, z, w = text(8), text(40), text(50), text(60), text(200)
    rows = [(1, f"{line}\n{x}"), (2, f"{x}\n{text(30)}"), (2, f"{y}\n{line}"), (2, z), (3, z), (3, w), (4, w.replace(w[50:60], "qq", 1)), (4, "alone " + text(30)), (4, "alone " + text(30)), (5, None), (5, ""), (None, text(20)), (None, text(25))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _gone int, _doc int, _mine int, _code int"
    docs = spark.createDataFrame([(d, t, "en", "s", 0, 1, 2, 3, 4) for d, t in rows], schema)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")

    def run(name, rows):
        out = dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame([(d, t, "en", "s", 0, 1, 2, 3, 4) for d, t in rows], schema), TOP)
        return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=order)

    assert run("toxicity", rows) == sorted(rows, key=order)
    keyed = [tuple(r) for r in docs.selectExpr("doc_id", "xxhash64(text)", "text").collect()]
    gone = {x[:3] for x in brute_lines(keyed, 1, corpus_pipeline.NEAR_CHARS)}
    lined = [(d, None if t is None else "\n".join(v for n, v in enumerate(t.split("\n")) if (d, k, n) not in gone)) for d, k, t in keyed]
    assert run("line_dedup", rows) == sorted(lined, key=order) and len(gone) == 3
    sets = [shingles(t) for _, t in rows]
    near = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    keep = [r for k, r in enumerate(rows) if not any(near(sets[k], sets[m]) and (q[0] or -1) < (r[0] or -1) for m, q in enumerate(rows))]
    assert run("near_dedup", rows) == sorted(keep, key=order) and len(keep) == len(rows) - 2
    assert run("suffix_dedup", rows) == sorted(zip([d for d, _ in rows], brute_cut([t for _, t in rows])), key=order)
    packed = corpus_pipeline.packing(spark, docs, TOP).collect()
    assert sum(r["end"] - r["start"] for r in packed) == sum(len((t or "").encode()) for _, t in rows)


def test_all_text_is_packed(kept):
    _, before, after = kept[4]
    assert after.selectExpr("sum(`end` - start)").first()[0] == before.selectExpr("sum(octet_length(text))").first()[0]


@pytest.mark.parametrize("case", ["empty", "odd"])
def test_stages_take_odd_tables(spark, case):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _doc int, _spans string"
    rows = [] if case == "empty" else [(1, None, None, None, None, 1, "x"), (None, "some words " * 60, "en", None, 5, 2, "y"), (2, "", "en", "s", 0, 3, None), (2, "", "en", "s", 0, 3, None), (3, "some words " * 60, "en", "s", 0, 3, None)]
    docs = spark.createDataFrame(rows, schema)
    for name, f in corpus_pipeline.STAGES:
        docs = stored(spark, f(spark, docs, TOP), name)
        assert docs.count() <= max(len(rows), 0) or name == "packing"


def test_short_passages_of_over_50_words_go(spark):
    fifty_one, fifty = " ".join(f"w{k}" for k in range(51)), " ".join(f"v{k}" for k in range(50))
    assert len(fifty_one) < suffixes.LENGTH
    spaced = fifty_one.replace(" ", "\n", 3)
    long = "".join(chr(0x4E00 + k) for k in range(150))  # one word of over 400 bytes
    rows = [(1, f"one {fifty_one} tail {fifty} x {long}"), (2, f"two\n{spaced} end {fifty} y {long}"), (3, f"three {fifty} z"), (4, None), (5, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: None if r["text"] is None else r["text"].split() for r in corpus_pipeline.suffix_dedup(spark, docs, TOP).collect()}
    assert got == {1: ["one", "tail", *fifty.split(), "x"], 2: ["two", "end", *fifty.split(), "y"], 3: ["three", *fifty.split(), "z"], 4: None, 5: []}
