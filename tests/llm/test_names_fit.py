import random
import string

import numpy as np

from mailweir.llm import names as N
from mailweir.llm import pii as P

SURNAMES = ["".join(p).capitalize() for p in zip(*(random.Random(k).choices(string.ascii_lowercase, k=40) for k in range(9)))]


def texts():
    """Forty surnames, each in the signatures of two of 8,000 texts."""
    signed = [f"Please see the plan.\n\nBest regards,\nAnna {name}" for name in SURNAMES for _ in range(2)]
    return signed + [f"Hello, the order {i} was shipped. Anna {SURNAMES[i % 40]} knows more." if i % 5 == 0 else f"The report {i} is ready." for i in range(8000 - len(signed))]


def frame(spark, rows, partitions):
    return spark.createDataFrame([*enumerate(rows), (-1, None), (-2, "")], "doc_id long, text string").repartition(partitions)


def test_the_model_comes_from_all_documents(spark):
    rows = texts()
    model = P.fitted(frame(spark, rows, 3))
    assert [s for s in SURNAMES if not model.known(s)] == []
    whole = N.fit(rows)
    assert (model.lexicon == whole.lexicon).all() and np.abs(model.weights - whole.weights).max() < 1e-3


def test_documents_without_seeds(spark):
    assert not P.fitted(frame(spark, ["plain text"], 2)).lexicon.any() and not P.fitted(frame(spark, [], 1)).lexicon.any()


def test_blocks_and_their_order_do_not_matter(monkeypatch):
    rows = texts()[:1000]
    whole = N.fit(rows)
    monkeypatch.setattr(N, "BLOCK", 2000)
    monkeypatch.setattr(N, "HELD", 50)
    parted = N.fit(rows[::-1])
    assert (whole.lexicon == parted.lexicon).all() and np.abs(whole.weights - parted.weights).max() < 1e-3
    assert whole.find(rows) == [s for r in rows for s in whole.find([r])]


def test_many_initials_end():
    rows = [f"Thanks,\nAnna {SURNAMES[0]}", f"by A. B. C. D. {SURNAMES[0]} today"] * 3
    assert N.fit(rows).known(SURNAMES[0])


def test_gradient_of_equal_examples():
    text = f"Regards,\nAnna {SURNAMES[1]}\nmet Anna {SURNAMES[1]}."
    lexicon = N.lexicon_of(["Anna", SURNAMES[1]])
    w = np.append(np.random.default_rng(1).normal(size=N.BUCKETS), 0.0)
    one, many, apart = (sum(N.gradient(e, w) for e in N.examples(coded, lexicon)) for coded in ([N.Block([text]).pack()], [N.Block([text] * 7).pack()], [N.Block([text]).pack()] * 7))
    assert np.abs(one).max() > 0.1 and np.allclose(7 * one, many) and np.allclose(many, apart)


def test_words_beside_names_are_no_parts():
    counts = N.census(["ANNA came. Anna Schmidt, Applicant", "the Applicant"], N.Block(["ANNA came. Anna Schmidt, Applicant", "the Applicant"]))
    assert counts[2]["Applicant"] == 2 and counts[2]["Anna"] == 2 and counts[1]["the"] == counts[1]["came"] == 1
    assert N.listed("Schmidt", 50, 90) and not N.listed("Applicant", 12, 5000) and not N.listed("Schmidt", 1, 1)
