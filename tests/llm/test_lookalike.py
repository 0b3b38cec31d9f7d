import random

from hypothesis import given
from hypothesis import strategies as st

from mailweir.llm.canonical import canonical
from mailweir.llm import lookalike as K

POOL = "abеоcЕ ̣́ﬁ１ﾠ​­ДЂйểéơo̕ʼn… \n가각ᄀÐ "


@given(st.text(alphabet=POOL, max_size=25))
def test_splicing_equals_the_whole_text_form(text):
    assert K.splice(text) == canonical(text)
    assert K.splice(K.splice(text)) == K.splice(text)


@given(st.text(max_size=30))
def test_any_text(text):
    assert K.splice(text) == canonical(text)


def test_forms():
    assert K.splice("Ｆｕｌｌ　ｗｉｄｔｈ") == "Full width"
    assert K.splice("Vie\u0302\u0323t \u200bNam\u00a0\u00ad!") == "Việt Nam !"
    assert K.splice("Раураl ﬁle 𝐁𝐨𝐥𝐝 Ðà") == "Paypal file Bold Đà"
    assert K.splice(None) is None and K.splice("") == ""


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "id string, subject string, body string, lo string, n int")


def test_pairs(spark):
    body = "an ordinary text of many letters"
    odd = body.replace("o", "о")
    rows = [("2", "s", body), ("1", "s", odd), ("3", "s", body), ("4", "s", body.upper()), ("5", None, odd), ("6", "", body), ("7", "", "few"), ("8", "", "fеw"), ("9", None, None), ("10", "s", odd + "\u200b")]
    got = sorted(tuple(r) for r in K.disguised_pairs(frame(spark, rows)).collect())
    assert got == [("1", "10"), ("1", "2"), ("1", "3"), ("10", "2"), ("10", "3"), ("5", "6")]
    assert K.disguised_pairs(frame(spark, [])).count() == 0


def test_against_brute_force(spark):
    r = random.Random(2)
    rows = []
    for i in range(120):
        text = "the same sentence of letters number " + "abc"[i % 3]
        for _ in range(r.randint(0, 2)):
            text = text.replace(*r.choice([("e", "е"), ("s", "ѕ"), (" ", "\u00a0"), ("t", "t\u200b")]), 1)
        rows.append((f"{i:03}", "subject", text))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] != b[2] and canonical(a[2]) == canonical(b[2])}
    assert {tuple(x) for x in K.disguised_pairs(frame(spark, rows)).collect()} == want
