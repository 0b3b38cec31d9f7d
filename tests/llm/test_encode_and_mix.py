import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mailweir.llm import encode as E
from mailweir.llm import mixture as M

tokenizers = pytest.importorskip("tokenizers")
PUBLIC = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(PUBLIC.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def own():
    return E.Tokenizer()


def test_pattern_is_the_public_one():
    assert E.PATTERN == PUBLIC.PATTERN


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(reference, own, text):
    assert own.encode(text) == reference(text)


@pytest.mark.parametrize("text", ["a" * 5000, "đ" * 3000, "ab" * 4000 + " end", "<|endoftext|>", " \n\t  x", "\u200b", "1234567890" * 300])
def test_long_and_odd_texts(reference, own, text):
    assert own.encode(text) == reference(text)


def test_bytes_come_back(own):
    back = {v: k for k, v in own.ranks.items()}
    text = "Việt Nam, ☃ and café – déjà vu 12345"
    assert b"".join(back[i] for i in own.encode(text)).decode() == text


def documents(spark, rows):
    return spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, source string, ids string, n_tokens int")


def test_null_and_empty(spark):
    got = {r["doc_id"]: r["ids"] for r in E.encode_corpus(documents(spark, [(1, None, None), (2, "", "a"), (3, " ", "a"), (3, "x", None)])).collect()}
    assert got[1] == [] and got[2] == []
    assert E.encode_corpus(documents(spark, [])).count() == 0


WEIGHTS = "source string, target_share double, max_repeats int, n_docs int"


def test_mix_reaches_the_shares(spark):
    rows = [(i, "word " * (1 + i % 9), "big" if i < 3000 else "small" if i < 3300 else "tiny" if i < 3320 else None if i < 3330 else "unweighted") for i in range(3400)]
    weights = spark.createDataFrame([("big", 0.6, 1, 0), ("small", 0.3, 6, 0), ("tiny", 0.1, 3, 0), ("absent", 0.0, 2, 0)], WEIGHTS)
    mixed = M.mix(documents(spark, rows), weights)
    report = {r["source"]: r for r in M.mix_report(mixed, weights).collect()}
    for s, share, most in (("big", 0.6, 1), ("small", 0.3, 6), ("tiny", 0.1, 3)):
        assert abs(report[s]["actual_share"] - share) < 0.02, s
        assert report[s]["most_times"] <= most
    assert report["absent"]["used_tokens"] == 0
    assert {r["source"] for r in mixed.select("source").distinct().collect()} == {"big", "small", "tiny"}


def test_mix_of_nothing(spark):
    weights = spark.createDataFrame([("a", 1.0, 1, 0)], WEIGHTS)
    assert M.mix(documents(spark, []), weights).count() == 0
    assert M.mix(documents(spark, [(1, None, "a"), (2, "", None)]), weights).count() == 0
    assert M.mix_report(M.mix(documents(spark, []), weights), weights).first()["actual_share"] == 0.0
