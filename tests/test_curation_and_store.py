import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailweir.functions import protect as P
from mailweir.operators import curation as C
from mailweir.sources.store import TABLES, MailStore


@given(st.text(alphabet="ab ZQ0X19./:@#-htpsw$%\n", max_size=60))
def test_protect_round_trip(text):
    masked, values, kinds = P.protect(text)
    assert P.restore(masked, values) == text and values.keys() == kinds.keys()


def test_protected_kinds():
    text = "See https://a.example/x). Write a@b.example on 2024-05-01 about USD 12.50 and PX-2001."
    _, values, kinds = P.protect(text)
    assert sorted((kinds[k], v) for k, v in values.items()) == [("AMOUNT", "USD 12.50"), ("CODE", "PX-2001"), ("DATE", "2024-05-01"), ("EMAIL", "a@b.example"), ("URL", "https://a.example/x")]
    assert P.quality_flags_of(text, "Xem https://a.example/x, a@b.example, 2024-05-01, USD 12.50, PX-2001 và hơn nữa.") == []
    assert "url_mismatch" in P.quality_flags_of(text, text.replace("https", "http")) and P.quality_flags_of("x", " ") == ["empty"]


def test_overlay_last_decision_wins(spark):
    proposals = spark.createDataFrame([(1, "spam"), (2, "spam"), (3, None), (4, "normal")], "k int, label string")
    decisions = spark.createDataFrame([(1, 1, "normal"), (1, 2, "phishing"), (2, 1, "defer")], "k int, ord int, decision string")
    got = {r["k"]: (r["final_label"], r["decided_by"]) for r in C.overlay(proposals, decisions, ["k"], F.col("ord").desc()).collect()}
    assert got == {1: ("phishing", "human"), 2: (None, "open"), 3: (None, "open"), 4: ("normal", "rule")}
    ids = lambda **kw: sorted(r["k"] for r in C.pending(proposals, decisions, ["k"], F.col("ord").desc(), **kw).collect())
    assert ids() == [3, 4] and ids(revisit=True) == [2, 3, 4]


def test_subset_and_batches(spark):
    with pytest.raises(ValueError):
        C.subset(spark.range(1), {"x": [1]})

    def shout(values):
        if "bad" in values and len(values) > 1:
            raise RuntimeError("batch")
        if values == ["bad"]:
            raise RuntimeError("row")
        return [v.upper() for v in values]

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "t string")
    got = {r["t"]: (r["out"], r["out_error"]) for r in C.map_batches(df, "t", "out", shout).collect()}
    assert got == {"a": ("A", None), "bad": (None, "RuntimeError: row"), "c": ("C", None)}


def mails(spark, *ids):
    rows = [(i, f"<{e}>" if e else None, "a", "b", "", "s", "t", None, "hop_thu_den", 0, 0, "2024") for i, e in ids]
    return spark.createDataFrame(rows, TABLES["thu"])


def test_store(spark, tmp_path):
    store = MailStore(spark, str(tmp_path / "s"))
    analyses = spark.createDataFrame([(1, 1, "v", "spam", 0.9, 50.0, "HIGH", 1, "{}", "2024-01-01"), (2, 1, "v", "normal", 0.9, 5.0, "LOW", 0, "{}", "2024-01-02"), (3, 9, "v", "spam", 0.9, 5.0, "LOW", 0, "{}", "2024")], TABLES["phan_tich_thu"])
    assert store.receive(mails(spark, (1, "x"), (2, "x"), (3, None)), analyses) == 2
    assert store.receive(mails(spark, (4, "x"))) == 0
    assert store.move(mails(spark, (1, "x")), "thu_rac", "spam", "2024-02-01") == 1
    assert store.move(mails(spark, (1, "x")), "thu_rac", "again", "2024-02-02") == 0
    with pytest.raises(ValueError):
        store.move(mails(spark, (1, "x")), "thu_rac", " ", "2024")
    view = {r["id_thu"]: (r["folder_now"], r["nhan_du_doan"]) for r in MailStore(spark, str(tmp_path / "s")).view().collect()}
    assert view == {1: ("thu_rac", "normal"), 3: ("hop_thu_den", None)}
    (tmp_path / "s" / "version.json").write_text(json.dumps({"version": 99}))
    with pytest.raises(ValueError, match="99"):
        MailStore(spark, str(tmp_path / "s"))


def test_events_feedback_and_health(spark, tmp_path):
    store = MailStore(spark, str(tmp_path / "events"))
    names = [c.split()[0] for c in TABLES["thu"].split(", ")]
    rows = [tuple({"id_thu": i, "ma_thu_ngoai": f"x{i}", "thu_muc": "hop_thu_den", "da_doc": 0, "da_gan_sao": 0}.get(n) for n in names) for i in (1, 2)]
    store.receive(spark.createDataFrame(rows, TABLES["thu"]))
    ids = spark.createDataFrame([(1,)], "id_thu long")
    assert store.set_flag(ids, "read", True, "2024-01-01") == 1 and store.set_flag(ids, "read", True, "2024-01-02") == 0
    assert store.set_flag(ids, "star", True, "2024-01-01") == 1 and store.set_flag(ids, "star", True, "2024-01-02") == 1
    assert {tuple(r) for r in store.flags().collect()} == {(1, 1, 1), (2, 0, 0)}
    assert store.feedback(ids, "mark_spam", "2024-01-03") == 1 and store.feedback(ids, "mark_spam", "2024-01-04") == 0
    assert store.table("phan_hoi").count() == 2 and store.feedback(ids, "report_error", "2024-01-05") == 0
    row = store.open_mail(2, "2024-01-06").first()
    assert row["da_doc"] == 1 and row["folder_now"] == "hop_thu_den" and store.view().filter("id_thu = 1").first()["folder_now"] == "thu_rac"
    with pytest.raises(KeyError):
        store.open_mail(9, "2024-01-06")
    with pytest.raises(ValueError):
        store.feedback(ids, "burn", "2024-01-06")
    health = {r["check"]: r["found"] for r in store.health().collect()}
    assert health["rows of phan_hoi"] == 3 and health["su_kien without mail"] == 0 and health["version"] == 2
