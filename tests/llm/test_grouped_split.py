from mailweir.llm import grouped_split as G

SCHEMA = "id string, group_id string, content_hash string, parent_id string, label string, split string, size int, class string"
TARGETS = [("train", 0.7), ("validation", 0.15), ("test", 0.15)]


def test_place_fills_the_ratios():
    items = [G.Item("big", 1, [30, 0]), G.Item("small", 200, [1, 0]), G.Item("rare", 20, [0, 1])]
    G.place(items, [0.7, 0.15, 0.15])
    rows = [sum(i.share[s] * sum(i.vector) for i in items) for s in range(3)]
    assert sum(rows) == 250
    assert all(abs(r / 250 - t) < 0.02 for r, t in zip(rows, (0.7, 0.15, 0.15)))
    assert [i.share for i in items if i.key == "rare"][0] == [14, 3, 3]


def test_split_keeps_groups_and_shares(spark):
    rows = [(f"m:{i}", f"g{i // 3}" if i % 2 else None, None, f"m:{i - 1}" if i % 5 == 0 and i else None, ["normal", "spam", None, "Phishing "][i % 4], "x", 1, "y") for i in range(900)]
    df, targets = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(TARGETS, "split string, ratio double")
    got = G.assign_splits(df, targets).toPandas()
    assert len(got) == 900 and got.id.is_unique
    assert got.groupby("component_id").split.nunique().max() == 1
    share = got.split.value_counts(normalize=True)
    assert all(abs(share[s] - r) < 0.02 for s, r in TARGETS)
    report = {r["split"]: r for r in G.split_report(G.assign_splits(df, targets), targets).collect()}
    assert sum(r["n_rows"] for r in report.values()) == 900


def test_one_giant_component(spark):
    rows = [(f"m:{i}", "g", None, None, "spam", None, 0, None) for i in range(60)] + [(f"n:{i}", None, None, None, "normal", None, 0, None) for i in range(40)]
    got = G.assign_splits(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(TARGETS, "split string, ratio double")).toPandas()
    assert got[got.id.str.startswith("m")].split.nunique() == 1 and len(got) == 100


def test_empty(spark):
    assert G.assign_splits(spark.createDataFrame([], SCHEMA), spark.createDataFrame(TARGETS, "split string, ratio double")).count() == 0
