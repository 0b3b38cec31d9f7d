import codecs
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from mailweir.functions import extract as X
from mailweir.functions import text as T
from mailweir.operators import rules as R
from mailweir.sources import files as S
from mailweir.sources.tables import require_columns


def value(spark, expr, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    out = [r["v"] for r in df.orderBy("i").select(expr(F.col("c")).alias("v")).collect()]
    return out[0] if len(out) == 1 else out


def test_normal_forms(spark):
    assert value(spark, T.normalize_text, "Ba\u0309n   tin\n\tmo\u031b\u0301i") == "Bản tin mới"
    assert value(spark, T.normalize_text, None, "　 x y ") == ["", "x y"]
    assert value(spark, T.fold_text, "Straße ＡＢ", None) == ["strasse ab", ""]
    assert value(spark, lambda c: T.strip_accents(c, "both"), "Đường đi") == "Duong di"
    assert value(spark, lambda c: T.strip_accents(c, "lower"), "Đường đi") == "Đuong di"
    assert value(spark, T.strip_accents, "Đường đi") == "Đuong đi"


def test_hashes_and_templates(spark):
    rows = [("s", "see https://a.example/1 now"), ("s", "see https://b.example/2 now"), ("S", "SEE  https://a.example/1 now")]
    df = spark.createDataFrame(rows, "s string, b string")
    got = df.select(T.content_hash(F.col("s"), F.col("b")).alias("c"), T.template_hash(F.col("s"), F.col("b")).alias("t")).collect()
    assert got[0]["c"] != got[1]["c"] and got[0]["t"] == got[1]["t"] and got[0]["c"] == got[2]["c"]
    spaced = spark.createDataFrame([("", "go http : / / x.example / login"), ("", "go https://y.example/z")], "s string, b string")
    a, b = [r["t"] for r in spaced.select(T.template_hash(F.col("s"), F.col("b"), spaced=True).alias("t")).collect()]
    assert a == b


def test_small_text_functions(spark):
    assert value(spark, lambda c: T.excerpt(c, 6), "a  longer text", "short", None) == ["a lon…", "short", ""]
    assert value(spark, lambda c: T.report_safe(c, 20), "=1+1", "x") == ["'=1+1", "x"]
    assert value(spark, T.display_timestamp, "2024-05-01T10:20:30Z", " ", "yesterday", None) == ["2024-05-01 10:20", "—", "yesterday", "—"]
    assert value(spark, lambda c: T.prefixed_subject(c)["subject"], "Chủ đề: X\nbody", "Chủ đề: X body", "none") == ["X", "", ""]
    assert value(spark, T.low_information, "too short", "a text with enough words in it, and long enough") == [True, False]
    assert value(spark, T.flag_yes, "Y", "eligible") == [True, False] and value(spark, T.flag_eligible, "Y", "eligible") == [False, True]


def test_extraction(spark):
    assert value(spark, X.urls, "See https://example.com/login, then visit www.example.org/path).") == ["https://example.com/login", "www.example.org/path"]
    assert value(spark, X.malformed_urls, "go to hxxp://a.test/x and http : / / b.test / y or https://ok.test, www . c . test") == ["hxxp://a.test/x", "http : / / b.test / y", "www . c . test"]
    assert value(spark, X.loose_emails, "ann . bee @ mail . example") == ["ann.bee@mail.example"]
    assert value(spark, X.identifiers, "ref PX-2001 and ABCD") == ["px-2001"]
    assert value(spark, X.numbers, "7 12 345 12") == ["12", "345"]
    assert value(spark, X.urls, None) == []


def test_numbers_end_where_words_of_the_sql_end(spark):
    # a joiner ends a word; superscripts, marks and letters outside the BMP are part of it; other scripts have digits too
    assert value(spark, X.numbers, "22\u200d up", "\u200c22", "22\u00b2", "22\u0301 x", "\U0001d5b9082/26", "22_1 x22", "\u0661\u0662", "22\n") == [["22"], ["22"], [], [], ["26"], [], ["\u0661\u0662"], ["22"]]


def test_url_parts(spark):
    parts = value(spark, lambda c: X.url_parts(c, ("bit.ly",)), "http://192.0.2.10/login", "https://www.example.com/about", "https://xn--example-9za.test/p", "https://a.b.c.d.example.com/", "hxxp : / / 192 . 0 . 2 . 10 / login", "https://bit.ly/abc", "https://x.y.co.uk")
    assert (parts[0]["is_ip"], parts[0]["depth"], parts[0]["is_https"]) == (True, 0, False)
    assert (parts[1]["domain"], parts[1]["depth"]) == ("example.com", 0)
    assert parts[2]["punycode"] and parts[3]["depth"] == 4 and parts[5]["shortener"]
    assert parts[4]["obfuscated"] and parts[4]["analysis_url"] == "http://192.0.2.10/login"
    assert parts[6]["domain"] == "y.co.uk"


def test_rules(spark):
    rules = [{"id": "a", "code": "x", "regex": "(?i)foo"}, {"id": "b", "code": "x", "regex": "bar"}, {"id": "c", "code": "y", "regex": "baz"}]
    got = value(spark, lambda c: R.findings(c, rules), "Foo foo FOO fool bar")
    assert [(f["rule_id"], f["n"], f["evidence"]) for f in got] == [("a", 4, ["Foo"]), ("b", 1, ["bar"])]
    assert value(spark, lambda c: R.capped_sum(R.hit_codes(c, rules), {"x": 7.0, "y": 9.0}, 10.0), "foo bar", "foo baz", None) == [7.0, 10.0, 0.0]
    with pytest.raises(ValueError):
        R.with_level(spark.range(1), "id", [("A", 0, 5), ("B", 7, 9)])
    assert value(spark, lambda c: R.uppercase_share(c), "ABcd", "12") == [0.5, 0.0]


def test_delimited_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, enc in (("a.csv", "utf-8"), ("b.csv", "cp1252"), ("sub/c.csv", "utf-8-sig")):
        (tmp_path / name).write_bytes('id,text\n1,"café, ""x""\nnext"\n2,\n'.encode(enc))
    (tmp_path / "d.tsv").write_bytes("id\ttext\n1\tplain\n".encode())
    (tmp_path / "skip.txt").write_text("x")
    paths = S.discover(str(tmp_path))
    assert [os.path.basename(p) for p in paths] == ["a.csv", "b.csv", "d.tsv", "c.csv"]
    assert [S.probe_encoding(p) for p in paths] == ["utf-8", "cp1252", "utf-8", "utf-8-sig"]
    for p in (paths[0], paths[1], paths[3]):
        df = S.read_any(spark, p)
        assert df.columns == ["id", "text"] and df.filter("id = 1").first()["text"] == 'café, "x"\nnext'
    assert S.read_any(spark, paths[2], ["text", "absent"]).collect()[0].asDict() == {"text": "plain"}
    with pytest.raises(FileNotFoundError):
        S.discover(str(tmp_path / "none"))
    assert codecs.BOM_UTF8 == (tmp_path / "sub/c.csv").read_bytes()[:3]


def test_guarded_reads(spark, tmp_path):
    schema = StructType([StructField("a", StringType()), StructField("n", LongType())])
    errors = []
    assert S.read_optional(spark, str(tmp_path / "no"), schema, errors).count() == 0 and len(errors) == 1
    spark.createDataFrame([("x", 1)], "a string, n int").write.parquet(str(tmp_path / "yes"))
    assert S.read_optional(spark, str(tmp_path / "yes"), schema, errors).first()["n"] == 1 and len(errors) == 1
    with pytest.raises(ValueError, match="blank"):
        spark.createDataFrame([("x", " ")], "id string, body string").write.parquet(str(tmp_path / "split"))
        S.read_split(spark, str(tmp_path / "split"), ["id", "body"])
    with pytest.raises(ValueError, match="b, c"):
        require_columns(spark.range(1), ["c", "id", "b"], "x")
    (tmp_path / "c.json").write_text(json.dumps({"a": 1}))
    with pytest.raises(ValueError, match="lacks"):
        S.load_config(str(tmp_path / "c.json"), ["a", "b"])


def test_publish_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    S.publish(spark.range(3), path)

    def refuse(df):
        raise ValueError("bad")

    with pytest.raises(ValueError):
        S.publish(spark.range(9), path, refuse)
    assert spark.read.parquet(path).count() == 3 and not os.path.exists(path + ".staging")
    S.publish(spark.range(5), path, lambda df: None)
    assert spark.read.parquet(path).count() == 5


def test_unchanged(tmp_path):
    p = tmp_path / "x"
    p.write_text("1")
    with S.unchanged(str(p)):
        pass
    with pytest.raises(RuntimeError):
        with S.unchanged(str(p)):
            p.write_text("2")


MAIL = b"From: Ann <a@x.example>\nTo: b@y.example\nCc: c@z.example\nSubject: =?utf-8?q?Ch=C3=A0o?=\nDate: Mon, 1 Jan 2024 00:00:00 +0000\n"


def test_mails(spark, tmp_path):
    plain = S.parse_mail(MAIL + b"\nhello\n")
    assert plain == {"sender": "Ann <a@x.example>", "receiver": "b@y.example, c@z.example", "date": "Mon, 1 Jan 2024 00:00:00 +0000", "subject": "Chào", "body": "hello"}
    rich = S.parse_mail(MAIL + b'Content-Type: text/html; charset=nope\n\n<p>Hi <b>you</b></p><script>x()</script><a href="https://l.example">go</a>')
    assert rich["body"] == "Hi you go\nhttps://l.example"
    with pytest.raises(TypeError):
        S.parse_mail("text")
    (tmp_path / "m.eml").write_bytes(MAIL + b"\nhello\n")
    assert S.read_mails(spark, str(tmp_path)).first()["subject"] == "Chào"
    assert value(spark, S.mail_address, "Ann <a@[192.0.2.1]>", "nobody", None)[0]["domain"] == "192.0.2.1"


def test_strict_json(spark):
    df = spark.createDataFrame([(1.5, float("nan"), "x")], "a double, b double, c string")
    assert json.loads(S.as_json_lines(df).first()["line"]) == {"a": 1.5, "b": None, "c": "x"}
