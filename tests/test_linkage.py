"""Blocking, features, scores and outputs on small tables, and every query against its SQL."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kinfold.operators import ann, blocking, metrics, models, validate
from kinfold.operators.records import normalize
from kinfold.plans import queries as Q
from kinfold.sources import records as src

TOP = "/root/testdata/sf0.001"


def keys(spark, n1, n2, key_id=0):
    rows = [(key_id, "X", "k", f"S1-{i}", 1) for i in range(n1)] + [(key_id, "X", "k", f"S2-{i}", 2) for i in range(n2)]
    return spark.createDataFrame(rows, "key_id int, country string, key string, eid string, src int")


@pytest.mark.parametrize(("n1", "n2", "k", "want"), [(3, 20, 0, 60), (3, 21, 0, 0), (3, 31, 4, 0), (5, 0, 4, 0), (12_501, 20, 1, 0), (2, 60, 5, 120)])
def test_caps(spark, n1, n2, k, want):
    assert blocking.capped_pairs(keys(spark, n1, n2, k)).count() == want


def test_corroboration_takes_over(spark):
    k = keys(spark, 3, 21)
    records = k.select("eid", F.when(F.col("eid").isin("S1-0", "S2-5"), 7).cast("long").alias("pin"), F.when(F.col("eid").isin("S1-1", "S2-6", "S2-7"), "ma").otherwise("").alias("state"))
    got = {(r["s1_id"], r["s2_id"]) for r in blocking.corroborated_pairs(k, records).collect()}
    assert got == {("S1-0", "S2-5"), ("S1-1", "S2-6"), ("S1-1", "S2-7")}


def test_presets_are_nested(spark):
    r = Q.entities(spark, TOP)
    sizes = [blocking.capped_pairs(blocking.blocking_keys(r, (0, 2, 12)), blocking.CAPS[p]).count() for p in ("tight", "current", "loose")]
    assert sizes == sorted(sizes)


def test_one_to_one(spark):
    s = spark.createDataFrame([("A", "x", 0.90), ("B", "x", 0.95), ("A", "y", 0.50), ("B", "z", 0.9), ("A", "z", 0.9)], "s1_id string, s2_id string, p double")
    assert {(r[0], r[1]) for r in metrics.resolve(s, 0.6).collect()} == {("B", "x"), ("A", "z")}
    assert metrics.resolve(s, 0.99).count() == 0
    assert metrics.resolve(s, 0.6, False).count() == 4


@pytest.mark.parametrize(("gold", "kept", "want"), [(["a", "b"], ["a"], 0.833333), (["a"], ["a", "b"], 0.555556), ([], [], 1.0), ([], ["a"], 0.0), (["a", "b"], [], 0.0)])
def test_f05(spark, gold, kept, want):
    pair = "s1_id string, s2_id string"
    one = spark.createDataFrame([("S",)], "eid string")
    s = metrics.entity_scores(one, spark.createDataFrame([("S", x) for x in kept], pair), spark.createDataFrame([("S", x) for x in gold], pair))
    assert s.first()["f05"] == pytest.approx(want, abs=1e-6)


def test_records_of_two_scripts(spark):
    rows = [("S1-1", "लक्ष्मी प्राइवेट लिमिटेड", "12 MG Road, दिल्ली 110001", "IN", 1), ("S2-1", "Laxmi Private Limited", "12 M.G. Road 110001", "IN", 2), ("S3-1", None, None, None, 3)]
    r = {x["eid"]: x for x in normalize(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string, src int")).collect()}
    assert r["S1-1"]["name_toks"][0] == "laxmi" and r["S1-1"]["alt_name_toks"] is not None and r["S1-1"]["pin"] == 110001
    assert r["S2-1"]["core_toks"] == ["laxmi"] and r["S2-1"]["alt_name_toks"] is None
    assert r["S3-1"]["name_toks"] == [] and r["S3-1"]["pin"] is None and r["S3-1"]["state"] == ""


def test_tsv_and_gold(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    src.write_tsv(spark.createDataFrame([("S1-1", "S2-1,S3-2"), ("S1-2", "")], src.GOLD), path)
    assert sorted(map(tuple, src.read_gold(spark, path).collect())) == [("S1-1", "S2-1"), ("S1-1", "S3-2")]
    assert sorted(r[0] for r in src.read_ids(spark, path.replace("/x", "/y")).collect()) == ["S1-1"] if src.write_tsv(spark.createDataFrame([("S1-1", 1), ("S1-1", 2)], "entity_id string, n int"), path.replace("/x", "/y")) is None else False


def test_validator(spark, tmp_path):
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "eid string")
    good, bad, cand = tmp_path / "good", tmp_path / "bad", tmp_path / "cand"
    good.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\n")
    cand.write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-2\nS1-2\t\n")
    bad.write_text("source1_entity_id,matched_entity_ids\nS1-1,x\n")
    rules = lambda f: {r["rule"] for r in f.collect()}
    f = validate.validate(spark, f"file://{good}", required, f"file://{cand}")
    assert rules(f) == {"not_in_candidates", "ids_not_checked"} and validate.exit_code(f) == 0
    assert "comma_header" in rules(validate.validate(spark, f"file://{bad}", required))
    assert "missing_file" in rules(validate.validate(spark, f"file://{tmp_path}/none", required))
    (tmp_path / "raw").write_bytes(b"source1_entity_id\tmatched_entity_ids\nS1-1\t\xff\xfe\n")
    assert "not_utf8" in rules(validate.validate(spark, f"file://{tmp_path}/raw", required))
    (tmp_path / "void").write_text("")
    assert "empty_file" in rules(validate.validate(spark, f"file://{tmp_path}/void", required))


def test_every_kth_of_many_rows(spark, tmp_path):
    n = 2_000_000  # ranges are drawn from samples of so many
    spark.range(n).select((F.col("id") * 7919 % n).alias("id")).repartition(16).write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    want = list(range(0, n, 17))
    assert sorted(r["id"] for r in src.every_kth(df, 17, "id").collect()) == want
    assert sorted(r["id"] for r in src.every_kth(df, 17, "id", f"{tmp_path}/kept").collect()) == want
    some = spark.createDataFrame([(None,), (2,), (1,), (None,)], "id long")
    assert [r["id"] for r in src.every_kth(some, 4, "id").collect()] == [1]


def test_copies_of_a_vector_rank_by_id_and_make_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 300)  # leaves are cut
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", F.col("embedding").alias("vec")).limit(40)
    v = base.crossJoin(spark.range(30).withColumnRenamed("id", "k")).select((F.col("vec_id") + F.col("k") * 1_000_000).alias("id"), "vec").persist()
    index = ann.build_ivf(v, 4, 2)
    found = ann.ivf_join(v.where("id < 1000000"), v, index, 10, (4, 2))
    rows = found.collect()
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    for q in {r["q_id"] for r in rows}:
        assert [r["id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["q_id"] == q] == [q + k * 1_000_000 for k in range(1, 11)]
    assert len(rows) == 400


def test_ivf_recall(spark):
    v = Q.vectors(spark, TOP)
    q = v.where("id % 25 = 0")
    exact = {(r["q_id"], r["id"]) for r in ann.exact_knn(q, v, 10).collect()}
    index = ann.build_ivf(v, 8, 4)
    probes, measured = ann.choose_probes(q, v, index, 10)
    for p, least in ((probes, 0.9), ((8, 4), 1.0)):  # all leaves probed: exact
        found = {(r["q_id"], r["id"]) for r in ann.ivf_join(q, v, index, 10, p).collect()}
        assert len(exact & found) >= least * len(exact)
    assert measured >= 0.9


def test_exact_search_in_blocks(spark):
    v = Q.vectors(spark, TOP)
    rows = lambda df: sorted((r["q_id"], r["id"], r["rank"], round(r["cos"], 9)) for r in df.collect())
    for options in ({}, {"cutoff": 0.3}, {"exclude_self": False}):
        few, many = ann.exact_knn(v, v, 7, **options), ann.exact_knn(v, v, 7, block=37, **options)
        assert rows(few) == rows(many) and few.count() > 0
    m = {r["id"]: __import__("numpy").array(r["vec"], float) for r in v.collect()}
    one = min(m)
    cos = sorted(((-float(x @ m[one] / (x @ x) ** 0.5 / (m[one] @ m[one]) ** 0.5), i) for i, x in m.items() if i != one))[:7]
    assert [i for _, i in cos] == [r[1] for r in sorted(rows(ann.exact_knn(v.where(F.col("id") == one), v, 7)), key=lambda r: r[2])]


def test_encoder(spark, tmp_path):
    t = spark.createDataFrame([(1, "acme trading company london "), (2, "acne tradng company london "), (3, "quite another thing here ")], "id int, text string")
    e = ann.Encoder(1 << 12, 64).fit_idf(t)
    v = {r["id"]: r["vec"] for r in e.embed(t).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert dot(v[1], v[2]) > dot(v[1], v[3]) + 0.15
    e.save(tmp_path / "e.npz")
    assert (ann.Encoder.load(tmp_path / "e.npz").w == e.w).all()
    bags = [__import__("numpy").array(r[0]) for r in t.select(ann.bucketed(ann.grams(F.col("text")), 1 << 12)).collect()]
    losses = [e.train_step([bags[0]], [bags[1]], [[bags[2]]]) for _ in range(20)]
    assert losses[-1] < losses[0]


def test_models(spark):
    f = spark.range(400).select(F.concat(F.lit("S1-"), F.col("id") % 40).alias("s1_id"), F.concat(F.lit("S2-"), F.col("id")).alias("s2_id"), (F.col("id") % 10 / 10.0).alias("x"), F.rand(1).alias("z")).withColumn("label", F.when(F.col("x") + 0.2 * F.col("z") > 0.6, 1.0).otherwise(0.0)).withColumn("is_val", metrics.holdout(F.col("s1_id")))
    f = f.persist()
    assert metrics.average_precision(models.score_gbt(models.fit_gbt(f, ("x", "z"), 5), f)).first()[0] > 0.9
    assert metrics.average_precision(models.score_logistic(models.fit_logistic(f, ("x", "z"), 0.01), f)).first()[0] > 0.9
    n = models.sample_negatives(f, 0.5).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in n}[1.0] == f.where("label = 1").count()
    assert len(models.sample_configs(5)) == 5
    _, config, results = models.search(f, models.sample_configs(2), ("x", "z"), 3)
    assert config in [c for c, _ in results]
    assert models.stack(f.withColumns({"p_gbt": F.col("x"), "p_lr": F.col("z")}), l2=0.01).count() == 400


def test_average_precision(spark):
    s = spark.createDataFrame([(0.9, 1.0), (0.8, 0.0), (0.8, 1.0), (0.1, 0.0)], "p double, label double")
    assert metrics.average_precision(s).first()[0] == pytest.approx((1 + 2 / 3) / 2)


def test_whole_run(spark, tmp_path):
    from kinfold.plans import link

    rows = Q.table(spark, TOP, "documents").where("length(text) > 60").select("doc_id", "lang", F.substring("text", 1, 40).alias("n"), F.substring("text", 20, 40).alias("a")).collect()
    clean = lambda x: " ".join(x.replace('"', "").split())
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    for k in (1, 2, 3):
        lines = [f"S{k}-{r['doc_id']}\t{clean(r['n']) if k < 3 else clean(r['n'])[:-2]}\t{clean(r['a'])}\t{r['lang']}\n" for r in rows if k == 1 or r["doc_id"] % 2 == k - 2]
        (tmp_path / f"s{k}.tsv").write_text(head + "".join(lines))
    (tmp_path / "gold.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{r['doc_id']}\tS{2 + r['doc_id'] % 2}-{r['doc_id']}\n" for r in rows))
    top = f"file://{tmp_path}"
    sources = [f"{top}/s{k}.tsv" for k in (1, 2, 3)]
    best = link.train(spark, sources, f"{top}/gold.tsv", f"{top}/work", 1, 3)
    assert best["macro_f05"] > 0.5
    link.predict(spark, sources, f"{top}/work", f"{top}/out")
    required = src.read_ids(spark, sources[0]).withColumnRenamed("entity_id", "eid")
    found = validate.validate(spark, f"{top}/out/matching_results.tsv", required, f"{top}/out/candidate_pairs.tsv", src.read_ids(spark, sources[1]).unionByName(src.read_ids(spark, sources[2])).withColumnRenamed("entity_id", "eid"))
    assert found.count() == 0


def norm(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        df[c] = df[c].map(lambda x: None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else (repr(float(x)) if isinstance(x, float) else str(x)))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(TOP):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{TOP}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, db, name):
    got = Q.QUERIES[name](spark, TOP).toPandas()
    if name in Q.ORACLES:
        want = db.execute(Q.ORACLES[name]).df()
        assert list(norm(got).columns) == list(norm(want).columns)
        pd.testing.assert_frame_equal(norm(got), norm(want))


def test_entry(spark):
    assert entry.entry(spark).columns == ["source1_entity_id", "matched_entity_ids"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
