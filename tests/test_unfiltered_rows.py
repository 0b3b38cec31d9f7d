import unicodedata

from mailweir.plans import source_queries, standardize_queries


def test_every_sender(spark, tmp_path):
    want = {
        1: "blueheron.test", 2: "mail.example", 3: "quoted.example", 4: None, 5: None, 6: "upper.example", 7: "brackets.example", 8: None,
    }
    senders = ["ilka-ashkettle@blueheron.test", "Ann Bee <ann@mail.example>", '"Bee, Ann" <ann@quoted.example>', None, "", "ANN@UPPER.EXAMPLE", "<ann@brackets.example>", "no address"]
    rows = list(enumerate(senders, 1))
    spark.createDataFrame(rows, "id_thu long, nguoi_gui string").write.parquet(f"{tmp_path}/thu.parquet")
    got = {r["id_thu"]: r["domain"] for r in source_queries.QUERIES["sender_addresses"](spark, str(tmp_path)).collect()}
    assert got == want


def test_every_subject(spark, tmp_path):
    subjects = ["Grüße aus Köln", "Tiếng Việt", unicodedata.normalize("NFD", "Trân trọng"), "раssword", "đường", "naïve 日本 ガ", "", None]
    rows = [(str(i), s) for i, s in enumerate(subjects)]
    spark.createDataFrame(rows, "id string, subject string").write.parquet(f"{tmp_path}/messages.parquet")
    got = {r["id"]: r["plain"] for r in standardize_queries.QUERIES["accent_forms"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, s in rows:
        marks_gone = "".join(c for c in unicodedata.normalize("NFD", s or "") if not unicodedata.combining(c))
        assert (got[i] or "") == unicodedata.normalize("NFC", marks_gone), s
