import pytest
from pyspark.sql import functions as F

from mailweir.operators import allocation as A
from mailweir.operators import groups as G
from mailweir.operators import leakage as L
from mailweir.operators import sampling as S
from mailweir.operators import standardize as Z

SCHEMA = "id string, parent_id string, group_id string, content_hash string, label string, split string, split_constraint string, training_eligible boolean"
GOOD = [
    ("a", None, "g1", "h1", "normal", "train", "flexible", True),
    ("b", "a", "g1", "h2", "normal", "train", "train_only", True),
    ("c", None, "g2", "h3", "spam", "test", "flexible", True),
    ("d", None, "g3", "h4", "phishing", "validation", "flexible", True),
]
CHECK = dict(keys=["group_id", "content_hash"], labels=("normal", "spam", "phishing"), train_only="split_constraint")


def changed(row, **kw):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return tuple(kw.get(n, v) for n, v in zip(names, row))


def test_valid_set(spark):
    L.validate_splits(spark.createDataFrame(GOOD, SCHEMA), **CHECK)


@pytest.mark.parametrize(
    "row, change, message",
    [
        (2, {"group_id": "g1"}, "group_id"), (2, {"content_hash": "h1"}, "content_hash"), (3, {"label": "review"}, "Invalid labels"), (3, {"training_eligible": None}, "non-training-eligible"),
        (2, {"id": "a"}, "Repeated ids"), (2, {"parent_id": "a"}, "Parent/translation"), (3, {"split_constraint": "train_only"}, "Train-only"),
    ],
)
def test_mutations(spark, row, change, message):
    rows = [changed(r, **change) if i == row else r for i, r in enumerate(GOOD)]
    with pytest.raises(L.LeakageError, match=message):
        L.validate_splits(spark.createDataFrame(rows, SCHEMA), **CHECK)


RATIOS = {"train": 0.7, "validation": 0.15, "test": 0.15}
GROUPS = "group_id string, size long, n_labels long, label string, stratum string, forced int"


def test_integer_targets(spark):
    totals = spark.createDataFrame([("a", 10), ("b", 0), ("c", 1)], "k string, total long")
    got = {(r["k"], r["split"]): r["target"] for r in A.integer_targets(totals, RATIOS, ["k"]).collect()}
    assert [got["a", s] for s in RATIOS] == [7, 2, 1] and [got["b", s] for s in RATIOS] == [0, 0, 0] and [got["c", s] for s in RATIOS] == [1, 0, 0]
    with pytest.raises(ValueError):
        A.integer_targets(totals, {"a": 0.5, "b": 0.4}, ["k"])


def test_allocation_keeps_targets(spark):
    rows = [(f"r{i}", f"g{i // (1 + i % 3)}", ["normal", "spam"][i % 2], f"s{i % 2}", "train_only" if i < 4 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, grp string, label string, source string, c string")
    groups = A.group_table(df, "grp", "label", "source", "c")
    got = A.assign(groups, RATIOS).toPandas()
    assert got.group_id.is_unique and len(got) == groups.count()
    both = got.merge(groups.toPandas(), on="group_id")
    assert (both[both.forced == 1].split == "train").all()
    share = both.groupby("split")["size"].sum() / both["size"].sum()
    assert abs(share["train"] - 0.7) < 0.03 and abs(share["test"] - 0.15) < 0.03


def test_a_giant_group_and_bound_groups(spark):
    rows = [("giant", 500, 1, "spam", "s", 0)] + [(f"g{i}", 1 + i % 3 // 2, 1, "spam", "s", None) for i in range(800)]
    rows += [("f1", 7, 1, "spam", "s", 1), ("f2", 2, 1, "spam", "t", 1)] + [(f"o{i}", 1, 1, None, None, None) for i in range(20)]
    got = {r["group_id"]: r["split"] for r in A.assign(spark.createDataFrame(rows, GROUPS), RATIOS).collect()}
    assert len(got) == len(rows) and got["f1"] == got["f2"] == got["giant"] == "train"
    size = {g: n for g, n, *_ in rows}
    spam = sum(n for g, n in size.items() if g[0] != "o")
    for s, r in RATIOS.items():
        assert abs(sum(n for g, n in size.items() if g[0] != "o" and got[g] == s) - r * spam) <= 4
    assert sum(got[f"o{i}"] == "train" for i in range(20)) == 14


def test_too_many_bound_rows_and_no_rows(spark):
    rows = [("f", 9, 1, "spam", "s", 1), ("g", 1, 1, "spam", "s", 0)]
    with pytest.raises(ValueError, match="exceed"):
        A.assign(spark.createDataFrame(rows, GROUPS), RATIOS)
    assert A.assign(spark.createDataFrame([], GROUPS), RATIOS).count() == 0


def test_groups_over_values_and_parents(spark):
    rows = [("a", "x", None, None), ("b", "x", "h", None), ("c", None, "h", None), ("d", " ", "", "c"), ("e", "y", None, None), ("f", None, None, "zz")]
    df = spark.createDataFrame(rows, "id string, g string, h string, parent_id string")
    keys = {"g": F.col("g"), "h": F.col("h")}
    with pytest.raises(ValueError, match="zz"):
        G.final_groups(df, keys)
    got = {r["id"]: r["root"] for r in G.final_groups(df, keys, missing="drop").collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "f"}
    assert {r["edge"]: r["n"] for r in G.edge_counters(df, keys).collect()} == {"g": 1, "h": 1, "parent": 1}
    named = {r["id"]: r["translation_group_id"] for r in G.translation_groups(df).collect()}
    assert named["c"] == named["d"] is not None and named["a"] is None


def test_a_long_chain_and_a_wide_star(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000)]
    got = {r["id"]: r["root"] for r in G.star_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(400)) and 5000 not in got
    keyed = spark.range(5000).selectExpr("'k' as k", "id")
    edges = G.value_edges(keyed)
    assert edges.count() == 4999 and edges.groupBy("u").count().agg(F.max("count")).first()[0] < 2 * G.FAN


def test_round_robin_takes_sources_in_turn(spark):
    df = spark.createDataFrame([(f"{s}{i}", "x", s) for s, n in (("a", 1), ("b", 5), ("c", 3)) for i in range(n)], "id string, label string, source string")
    got = [r["source"] for r in S.round_robin(df, "label", "source", "s", 7).orderBy("turn").collect()]
    assert got == ["a", "b", "c", "b", "c", "b", "c"]


def test_dispositions_conflict_before_duplicate(spark):
    rows = [("1", 1, "k", "spam"), ("2", 2, "k", "normal"), ("3", 3, "m", "spam"), ("4", 4, "m", "spam"), ("5", 5, None, "spam")]
    df = spark.createDataFrame(rows, "id string, original_row_id long, key string, label string")
    got = {r["id"]: (r["disposition"], r["canonical_id"], r["n_copies"]) for r in Z.dispositions(df).collect()}
    assert got["1"][0] == got["2"][0] == "label_conflict"
    assert got["3"] == ("kept", "3", 2) and got["4"] == ("exact_duplicate", "3", 2) and got["5"][0] == "kept"


def test_receive_twice_is_idempotent(spark, tmp_path):
    from mailweir.streaming.ingest import receive

    schema = "id_thu long, ma_thu_ngoai string, noi_dung string"
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, None, "c")], schema).coalesce(1).write.parquet(src)
    for _ in range(2):
        receive(spark.readStream.schema(schema).parquet(src), store).awaitTermination()
    got = sorted(r["id_thu"] for r in spark.read.parquet(store).filter("ma_thu_ngoai is not null").collect())
    assert got == [1]
