import math
import random

from pyspark.sql import functions as F

from mailweir.operators import features as X
from mailweir.operators import robustness as R


def test_calibration_gives_probabilities(spark):
    r = random.Random(1)
    rows = []
    for i in range(300):
        label = "ab"[i % 2]
        rows.append((i, label, r.gauss(1.0 if label == "a" else -1.0, 1.0), r.gauss(1.0 if label == "b" else -1.0, 1.0)))
    df = spark.createDataFrame(rows, "id int, label string, ma double, mb double")
    out = X.calibrated(df, {"a": "ma", "b": "mb"})
    assert X.probability_violations(out, ["p_a", "p_b"]).count() == 0
    assert X.probability_violations(out.withColumn("p_a", F.lit(None).cast("double")), ["p_a", "p_b"]).count() == 300
    right = out.filter((F.col("p_a") > 0.5) == (F.col("label") == "a")).count()
    assert right > 270


def test_group_folds_keep_groups(spark):
    df = spark.range(200).select(F.pmod("id", F.lit(40)).cast("string").alias("g"))
    assert X.group_folds(df, "g").groupBy("g").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([("1", "a1 b1 b1"), ("2", "a1 c1"), ("3", "")], "id string, t string")
    got = {(r["id"], r["term"]): r["weight"] for r in X.tfidf(df, F.split("t", " "), min_df=1).filter("term <> ''").collect()}
    idf_a, idf_b = math.log(4 / 3) + 1, math.log(4 / 2) + 1
    wb = (1 + math.log(2)) * idf_b
    assert math.isclose(got["1", "b1"], wb / math.hypot(idf_a, wb), rel_tol=1e-12)
    assert X.tfidf(df, F.split("t", " "), min_df=2).filter("term = 'c1'").count() == 0


def test_nearest_against_brute_force(spark):
    r = random.Random(2)
    vectors = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = {}
    for row in X.nearest(df.filter("vec_id % 50 = 0"), df, 4, per_block=2).collect():
        got.setdefault(row["query_id"], {})[row["rank"]] = row["vec_id"]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)
    for q in (0, 50, 100):
        want = sorted((i for i, _ in vectors if i != q), key=lambda i: -cos(vectors[q][1], vectors[i][1]))[:4]
        assert [got[q][k] for k in (1, 2, 3, 4)] == want


def test_variants(spark):
    df = spark.createDataFrame([("m", "Tài khoản a. b"), ("n", None)], "id string, body string")
    rows = {(r["parent_id"], r["variant"]): r["text"] for r in R.variants(df).collect()}
    assert len(rows) == 12 and rows["m", "clean"] == "Tài khoản a. b" and rows["m", "no_accents"] == "Tai khoan a. b"
    assert rows["m", "spacing"] == "Tài  khoản  a.  b" and rows["m", "punctuation"] == "Tài khoản a!! b ..." and rows["n", "clean"] == ""
    results = spark.createDataFrame([("m", "clean", "x", 0.9, 10.0), ("m", "spacing", "y", 0.6, 30.0)], "parent_id string, variant string, prediction string, confidence double, risk double")
    got = {r["scope"]: r for r in R.variant_measures(R.against_clean(results)).collect()}
    assert got["all_transformed"]["flip_rate"] == 1.0 and abs(got["spacing"]["mean_drop"] - 0.3) < 1e-9 and got["clean"]["n_rows"] == 1


def _plain_weights(rows, min_df):
    counts = {}
    for i, t in rows:
        for w in t.split():
            counts.setdefault(i, {}).setdefault(w, 0)
            counts[i][w] += 1
    df = {}
    for c in counts.values():
        for w in c:
            df[w] = df.get(w, 0) + 1
    out = {}
    for i, c in counts.items():
        x = {w: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[w])) + 1) for w, n in c.items() if df[w] >= min_df}
        norm = math.sqrt(sum(v * v for v in x.values()))
        out.update({(i, w): v / norm for w, v in x.items()})
    return out


def test_tfidf_of_common_and_rare_terms_shuffles_no_counts(spark, monkeypatch):
    monkeypatch.setattr(X, "RARE", 8)  # terms of fewer than 50 texts are rare
    monkeypatch.setattr(X, "TEXTS_A_TASK", 30)
    r = random.Random(3)
    rows = [(f"m{i}", " ".join(f"w{int(r.paretovariate(0.5)) % 500}" for _ in range(15))) for i in range(400)]
    for more in ([], [("m1", "w1 w1 w2 w77"), (None, "w1 w2 w2")]):  # an id twice, and none
        df = spark.createDataFrame(rows + more, "id string, t string")
        out = X.tfidf(df, F.split("t", " "))
        got, want = {(x["id"], x["term"]): x["weight"] for x in out.collect()}, _plain_weights(rows + more, 2)
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.split("\n") if "Exchange hashpartitioning(id" in x and "ENSURE_REQUIREMENTS" in x]
