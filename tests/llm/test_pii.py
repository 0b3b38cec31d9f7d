import functools
import os
import random
import time

import pyarrow.parquet as pq
from hypothesis import given
from hypothesis import strategies as st

from mailweir.llm import names as N
from mailweir.llm import pii as P
from mailweir.llm import pseudonym as S
from mailweir.llm.canonical import canonical

DATA = os.environ.get("TEST_NAMES_DIR", "/root/testdata/sf0.1")


@functools.cache
def model():
    texts = [t for t in pq.read_table(f"{DATA}/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    return N.fit([canonical(t) for t in random.Random(1).sample(texts, 3000)])


def found(text, dates=False):
    return sorted({(k, text[a:b]) for a, b, k in P.find_spans(text, model(), dates)})


def test_numbers():
    assert found("Call 1 (457) 555-0104 or +84 95 146 3412, fax (028) 0464 7883.") == [("phone", "(028) 0464 7883"), ("phone", "+84 95 146 3412"), ("phone", "1 (457) 555-0104")]
    assert found("Her passport number is P54571731. Social security number 921-48-3368, CCCD 097 113 083 155, ID no. QZ 38 02 64 C, số căn cước 498117528.") == [
        ("national_id", "097 113 083 155"), ("national_id", "498117528"), ("national_id", "921-48-3368"), ("national_id", "P54571731"), ("national_id", "QZ 38 02 64 C"),
    ]
    assert found("Meeting code 251 437 6038, serial 22722-47944-91137, tracking number 555076725534, Mã vận đơn 1442870767, INV-6867-933591, 10.0.32.44, 1.250.000 đồng") == []


def test_mailboxes():
    text = "a.b+c@mail.x.example, mailto:info@y.test; UP@VAN.EXAMPLE. k-o [at] q (dot) test, d . e @ o-p . example and https://x.example/@59014/item, @shop"
    assert [v for _, v in found(text)] == sorted(["a.b+c@mail.x.example", "info@y.test", "UP@VAN.EXAMPLE", "k-o [at] q (dot) test", "d . e @ o-p . example"])


def test_addresses():
    for a in ("230 Marrow Way, Apt 52, Tarnwick, QX 10754", "155 Wren Close, Flat 36, Lower Quill 83329", "312B Wren Lane, Tarnwick", "29 Ottermill St., Mossgate, QX 88056", "152 Saltgate Close #28, Mossgate 23730",
              "Số 71 đường Giếng Đá, phường Vĩnh Hạc, thành phố Sơn Hạ", "163/12 đường Cầu Mây, xã Sơn Mới, tỉnh Vân Trung", "226 Hoa Sen, P. Phú Lãm, TP. Tân Hải", "So 255 duong Cau May, phuong Tay Thanh Ha, thanh pho Lac Giang"):
        assert found(f"They live at {a} in spring. Next.") == [("address", a)], a
    assert found("Building 4, Room 558 is free on Street Market Day.") == []


def test_names():
    for n in ("Thessaly Quillmoor", "Durnevale, Verena", "T. Wexcombe", "lorcan okerby", "SABETH STOKEMARSH", "Kestra K. Varnholt", "Isaura Tolliver-Ness"):
        assert found(f"Ask for {n} when you arrive.") == [("person", n)], n
    assert found("The contract was signed by Odalys Durnevale and B. Okerby.") == [("person", "B. Okerby"), ("person", "Odalys Durnevale")]
    assert found("The visitor gave the name Osric Quillmoor and no other details.") == [("person", "Osric Quillmoor")]
    assert found("Hồ sơ của Ta Huu Nghi, CCCD 097387256733, đã được duyệt.") == [("national_id", "097387256733"), ("person", "Ta Huu Nghi")]
    assert found("Text.\n\nBest regards,\nStokemarsh, Brisa\n594-555-0159") == [("person", "Stokemarsh, Brisa"), ("phone", "594-555-0159")]
    assert found("Ask for Thessaly when you arrive. Blue Heron Ledger and Orvane Logistics merged.") == []


def test_names_that_the_sample_does_not_hold_in_new_sentences():
    assert found("My colleague Anna Schmidt lives in Berlin.") == [("person", "Anna Schmidt")]
    assert found("I met Robert Hughes yesterday.") == [("person", "Robert Hughes")]
    assert found("Yesterday John Smith called about the invoice.") == [("person", "John Smith")]
    assert found("We met in New York on Monday. The rest is fine.") == []


def test_no_seeds_no_names():
    assert N.fit([]).find(["Anna Schmidt"]) == [[]] and N.fit(["plain text"]).find(["", "Anna Schmidt"]) == [[], []]


def test_invalid_numbers_are_none():
    assert found("000-00-0000, 666-12-3456, 123-00-4567, 123-45-0000 and 000-000-0000 or 123 456 7890") == []


def test_long_disguised_mailboxes_and_addresses_of_other_lands():
    box = "a" * 150 + " . " + "b" * 150 + " @ " + "c" * 50 + " . example"
    assert found(f"Write to {box} now") == [("email", box)]
    for a in ("12 rue de la Paix, 75002 Paris", "Hauptstraße 12, 10115 Berlin", "Calle Mayor 5, 28013 Madrid"):
        assert found(f"at {a}.") == [("address", a)], a


def test_time_is_linear_in_the_length():
    unit = "My number is +84 95 146 3412, write to a.b@mail.example. Anna Schmidt met us at 12 Hill Road, Tarnwick 25323.\n"
    took = []
    for n in (300, 2400):
        began = time.process_time()
        P.find_spans(unit * n, model())
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.02)


def test_dates_of_birth_only():
    assert found("She was born on 12/03/1984. The batch ran from 2024-03-31.", dates=True) == [("date", "12/03/1984")]
    assert found("DOB: 1984-03-12, sinh ngày 5.6.1990", dates=True) == [("date", "1984-03-12"), ("date", "5.6.1990")]
    assert found("born 31/02/1984 and 45/45/1984", dates=True) == []


def test_values_stand_as_in_the_text():
    text = "Xin cập nhật hồ sơ: Ta\u0323 Die\u0302\u0303m Quye\u0302n, a\u200b@b.example"
    assert ("person", "Ta\u0323 Die\u0302\u0303m Quye\u0302n") in found(text)
    assert all(v in text for _, v in found(text))


@given(st.text(alphabet="0123456789", min_size=2, max_size=20), st.binary(min_size=1, max_size=8))
def test_pseudonyms_are_a_permutation(digits, key):
    new = S.feistel_digits(digits, key)
    assert len(new) == len(digits) and new.isdigit() and S.feistel_digits(new, key, undo=True) == digits


def test_permutation_of_all_short_numbers():
    assert len({S.feistel_digits(f"{i:03d}", b"k") for i in range(1000)}) == 1000


def test_spellings_of_one_number_stay_one_number():
    spelled = ["+84 95 146 3412", "0084 95 146 3412", "095 146 3412", "(+84) 95-146-3412", "0951463412"]
    new = [S.phone(v, b"key") for v in spelled]
    assert len({S.split_number(v)[:2] for v in new}) == 1 and S.split_number(new[0])[0] == "84" and S.valid_phone(new[0])
    assert new[0].startswith("+84 ") and new[2][0] == "0" and [len(a) for a in spelled] == [len(a) for a in new]
    assert [S.phone(v, b"key", undo=True) for v in new] == spelled
    assert len({S.split_number(S.phone(v, b"key"))[1] for v in ("+1 602 555 0102", "1 (602) 555-0102", "602.555.0102")}) == 1
    assert S.national_id("921-48-3368", b"k").replace("-", "") == S.national_id("921 48 3368", b"k").replace(" ", "")


@given(st.integers(S.FIRST_DAY, S.LAST_DAY))
def test_dates_in_all_formats(n):
    d = S.datetime.date.fromordinal(n)
    forms = [d.isoformat(), f"{d.day:02d}/{d.month:02d}/{d.year}", f"{d.day}.{d.month}.{d.year}", f"{d.day} {S.MONTHS[d.month - 1].capitalize()} {d.year}", f"{S.MONTHS[d.month - 1].capitalize()} {d.day}, {d.year}"]
    new = [S.date(x, b"key") for x in forms]
    assert len({S.read_date(x)[0] for x in new}) == 1
    back = [S.date(x, b"key", undo=True) for x in new]
    assert {S.read_date(x)[0] for x in back} == {n} and back[:2] == forms[:2] and back[3:] == forms[3:]


def test_redaction(spark):
    docs = [(1, "Call +84 95 146 3412 now, or 0084 95 146 3412.", "x"), (2, "call +84 95 146 3412!", "x"), (3, None, None), (4, "", None), (5, "plain text", None), (6, "word " * 60000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, kind string")
    got = {r["doc_id"]: r["text"] for r in P.redact_documents(df, "secret", N.Model()).collect()}
    assert got[3] is None and got[4] == "" and got[5] == "plain text" and got[6] == docs[5][1]
    assert "[PHONE +" in got[1] and got[1].endswith(".") and "3412" not in got[2]
    assert got[2][len("call ") : -1] in got[1]
    rows = [tuple(r) for r in P.find_pii(df, N.Model()).collect()]
    assert sorted(rows) == [(1, "phone", "+84 95 146 3412"), (1, "phone", "0084 95 146 3412"), (2, "phone", "+84 95 146 3412")]
    assert P.find_pii(df.limit(0)).count() == 0
