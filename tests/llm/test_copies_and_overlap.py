import random

from mailweir.llm import format_copies as FC
from mailweir.llm import split_overlap as SO
from mailweir.operators.skew import block_pairs, hot_threshold

SCHEMA = "id string, subject string, body string, split string, n long, lo long, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "clash") for r in rows], SCHEMA)


def test_copies(spark):
    long_text = "word " * 20000
    rows = [
        ("3", "Hello WORLD, this is it", "Some body text.", None),
        ("1", "hello world this is it", "SOME BODY-TEXT", None),
        ("2", "Some body text", "Hello\nworld; this is it", None),
        ("4", "Hеllo world this is it", "Some body text", None),  # a Cyrillic letter
        ("5", None, None, None),
        ("6", "", " ", None),
        ("7", "short", "text", None),
        ("8", "short", "text", None),
        ("9", long_text, None, None),
        ("10", None, long_text.upper(), None),
        ("11", "Straße straße straße straße", "x", None),
        ("12", "STRASSE STRASSE STRASSE STRASSE", "X", None),
    ]
    got = sorted(tuple(r) for r in FC.copy_pairs(frame(spark, rows)).collect())
    assert got == [("1", "2"), ("1", "3"), ("1", "4"), ("10", "9"), ("11", "12")]
    counts = {r["id"]: r["n_copies"] for r in FC.collapse(frame(spark, rows)).collect()}
    assert counts == {"1": 4, "5": 2, "7": 2, "10": 2, "11": 2}


def test_copies_hot_and_cold_agree(spark, monkeypatch):
    rows = [(f"{i:04}", f"subject number {i % 7 if i % 3 else 0} of the series", "the body", None) for i in range(300)]
    cold = sorted(tuple(r) for r in FC.copy_pairs(frame(spark, rows)).collect())
    monkeypatch.setattr(FC, "hot_threshold", lambda n: 20)
    assert sorted(tuple(r) for r in FC.copy_pairs(frame(spark, rows)).collect()) == cold
    assert len(cold) == 300 - 7


def test_copies_empty(spark):
    assert FC.copy_pairs(frame(spark, [])).count() == 0
    assert FC.collapse(frame(spark, [])).count() == 0


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_word_distance():
    r = random.Random(1)
    for _ in range(1500):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 14))] for _ in range(2))
        assert SO.word_distance(list(a), list(b)) == distance(a, b)


def test_overlap_against_brute_force(spark):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, texts = [], {}
    for i in range(60):
        base = [r.choice(vocabulary) for _ in range(r.randint(28, 90))]
        for j in range(3):
            ws = list(base)
            for _ in range(r.randint(0, len(base) // 8)):
                k = r.randrange(len(ws))
                act = r.random()
                if act < 0.6:
                    ws[k] = r.choice(vocabulary)
                elif act < 0.8:
                    ws.insert(k, r.choice(vocabulary))
                elif len(ws) > 1:
                    ws.pop(k)
            name = f"{i:02}-{j}"
            split = ["train", "test", " Validation"][j] if r.random() < 0.9 else None
            rows.append((name, " ".join(ws[:5]), " ".join(ws[5:]).title() if j else " ".join(ws[5:]), split))
            texts[name] = (ws, split)
    want = set()
    for a, (x, s) in texts.items():
        for b, (y, t) in texts.items():
            if s == "train" and t in ("test", " Validation") and len(x) >= 30 and len(y) >= 30 and 10 * distance(x, y) <= max(len(x), len(y)):
                want.add((min(a, b), max(a, b)))
    got = [tuple(x) for x in SO.overlap_found(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_overlap_swapped_fields_and_short_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    rows = [("1", a, b, "train"), ("2", b.upper(), a, "test"), ("3", "few words", "only", "train"), ("4", "few words", "only", "test"), ("5", None, None, "train"), ("6", a, b, None)]
    assert [tuple(x) for x in SO.overlap_found(frame(spark, rows)).collect()] == [("1", "2")]
    assert SO.overlap_found(frame(spark, [])).count() == 0


def test_report(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [("1", "s", text, "train"), ("2", "s", text, "test"), ("3", "s", text, "train")]
    df = frame(spark, rows).selectExpr("*", "if(id = '3', null, 'src') as source")
    got = {(r["split"], r["eval_source"], r["train_source"]): (r["pairs"], r["eval_records"]) for r in SO.overlap_report(df).collect()}
    assert got == {("test", "src", "src"): (1, 1), ("test", "src", "(none)"): (1, 1)}


def test_block_pairs(spark):
    a = spark.createDataFrame([("k", i, 25, 14) for i in range(25)], "key string, x int, n long, m long")
    b = spark.createDataFrame([("k", i, 25, 14) for i in range(14)], "key string, y int, n long, m long")
    got = [(r["x"], r["y"]) for r in block_pairs(a, b, ["key"], "n", "m", per_block=4).collect()]
    assert len(got) == len(set(got)) == 25 * 14


def test_hot_threshold_bounds_the_hot_table():
    for n in (0, 10, 10**5, 10**8, 4 * 10**8):
        assert n / hot_threshold(n) <= 4097
