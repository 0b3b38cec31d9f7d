import math
import re
from collections import Counter

from mailweir.plans import model_queries as Q

ROWS = [
    ("1", "Invoice due", "please pay the Überweisung\npay now", "spam"),
    ("2", None, "please read the Überweisung note", "normal"),
    ("3", "Invoice note", None, "normal"),
    ("4", None, None, None),
    ("5", "", "pay a note, pay now", "phishing"),
]


def write(spark, folder):
    spark.createDataFrame(ROWS, "id string, subject string, body string, label string").write.parquet(f"{folder}/messages.parquet")
    return str(folder)


def text(row):
    return f"{row[1] or ''}\n{row[2] or ''}".lower()


def brute_weights():
    counts = {}
    for row in ROWS:
        w = re.findall(r"\w\w+", text(row))
        counts[row[0]] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df = Counter(t for c in counts.values() for t in c)
    out = {}
    for i, c in counts.items():
        x = {t: (1 + math.log(n)) * (math.log((1 + len(ROWS)) / (1 + df[t])) + 1) for t, n in c.items() if df[t] >= 2}
        norm = math.sqrt(sum(v * v for v in x.values()))
        out.update({(i, t): v / norm for t, v in x.items()})
    return out


def close(got, want):
    return got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-6, abs_tol=1e-7) for k in want)


def test_subject_and_body_against_brute_force(spark, tmp_path):
    d = write(spark, tmp_path)
    want = brute_weights()
    assert ("2", "überweisung") in want
    assert close({(r["id"], r["term"]): r["weight"] for r in Q.QUERIES["tfidf_weights"](spark, d).collect()}, want)
    labels = {r[0]: r[3] for r in ROWS if r[3]}
    n = Counter(labels.values())
    coefficient = {}
    for t in {t for _, t in want}:
        s = Counter()
        for (i, u), v in want.items():
            if u == t and i in labels:
                s[labels[i]] += v
        coefficient.update({(t, k): v / n[k] - (sum(s.values()) - v) / (len(labels) - n[k]) for k, v in s.items()})
    assert close({(r["term"], r["label"]): r["coefficient"] for r in Q.QUERIES["tfidf_class_terms"](spark, d).collect()}, coefficient)
    top = {(r["id"], r["label"], r["term"]): r["contribution"] for r in Q.QUERIES["top_contributions"](spark, d).collect()}
    assert ("5", "phishing", "pay") in top  # stands in bodies only
    assert all(math.isclose(v, want[i, t] * coefficient[t, k], rel_tol=1e-6) for (i, k, t), v in top.items())


def test_char_ngrams_of_three_to_five(spark, tmp_path):
    want = Counter()
    for row in ROWS:
        for w in text(row).split():
            w = f" {w} "
            want.update(w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1))
    got = {r["term"]: r["n"] for r in Q.QUERIES["char_ngrams"](spark, write(spark, tmp_path)).collect()}
    assert got == want


def test_contributions_of_rare_terms_meet_no_checkpoint(spark, tmp_path, monkeypatch):
    from mailweir.operators import features as X

    d = write(spark, tmp_path)
    want = sorted((r["id"], r["label"], r["term"], round(r["contribution"], 9)) for r in Q.QUERIES["top_contributions"](spark, d).collect())
    monkeypatch.setattr(X, "RARE", 1)  # every term that not all texts hold is rare
    written = []
    monkeypatch.setattr(X, "cut", lambda df, real=X.cut: written.append(df.columns) or real(df))
    got = Q.QUERIES["top_contributions"](spark, d)
    assert sorted((r["id"], r["label"], r["term"], round(r["contribution"], 9)) for r in got.collect()) == want
    assert written == [["term", "df"]]  # neither weights nor contributions
