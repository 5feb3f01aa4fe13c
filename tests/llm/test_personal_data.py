import hashlib
import re

from recordloom.llm.personal_data import personal_data, personal_data_digest, redact


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, good in kinds for m in re.finditer(p, text) if good(m[0])]


def check(docs):
    got = sorted(map(tuple, (map(str, (r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256))
                             for r in personal_data_digest(docs).collect())))
    want = []
    for d in docs.collect():
        spans = base(d.text)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        counts = [sum(k == kind for k, *_ in spans) for kind in ("email", "ip", "card", "phone")]
        want.append(tuple(map(str, (d.doc_id, *counts, hashlib.sha256(listed.encode()).hexdigest()))))
    assert got == sorted(want)


def test_base_spans_equal_the_plain_patterns(documents, odd):
    check(documents)
    check(odd)


def test_hard_places(spark):
    texts = [
        "a@b.c_d@e.f x@y z@.q a@b..c %@a.b", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.0255 1.2.3", "4111111111111111 4111-1111 1111-1111",
        "4111 1111 1111 1112 12345678901234567890123 1 2 3 4 5 6 7 8 9 0 1 2 8", "+1 (213) 555-0199) ++49 30 123456789 +12 +1234567890123456",
        "é😀 a@b.cc 😀 192.168.0.1", "0000000000000 00000000000000000", "\n+1 234 567 890\n4242424242424242\t", "5 5- 5-5 5--5",
    ]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))


def test_cards_whose_digits_all_stand_apart(spark):
    texts = ["4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "no 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1, thanks", "4-1 1-1 1", "1 2 3 4 5 6 7 8 9 0 1 2 8"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    check(docs)
    assert {r.doc_id: r.text for r in redact(docs).collect()}[0] == "[CARD]"


def test_account_numbers_need_their_checksum_and_context_moves_the_score(spark):
    docs = spark.createDataFrame([(1, "bank account GB82 WEST 1234 5698 7654 32."), (2, "GB83WEST12345698765432"),
                                  (3, "invoice 4111111111111111"), (4, "visa card 4111111111111111")], "doc_id bigint, text string")
    found = {r.doc_id: [(s.kind, s.value, round(s.score, 2)) for s in r.spans] for r in personal_data(docs).collect()}
    assert found[1][0][0] == "iban" and found[2] == []
    assert found[3][0][2] < found[4][0][2]


def test_account_numbers_end_where_their_country_ends_them(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", "to GB82 WEST 1234 5698 7654 32 EUR 500",
             "DE89370400440532013000 GB82WEST12345698765432", "konto FR99 DE89 3704 0044 0532 0130 00 Bank",
             "DE89 3704 0044 0532 0130 00 " + "A1 " * 40, "DE88 3704 0044 0532 0130 00 BIC", "DE89370400440532013000BIC"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: [(s.value, texts[r.doc_id][s.start:s.end]) for s in r.spans if s.kind == "iban"]
             for r in personal_data(docs, 0.0).collect()}
    german, british = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    want = [[german], [british], [german.replace(" ", ""), british.replace(" ", "")], [german], [german], [], []]
    assert [found[i] for i in range(len(texts))] == [[(v, v) for v in values] for values in want]
    assert redact(docs, 0.0).where("doc_id = 0").first().text == "IBAN [IBAN] BIC COBADEFF"


def test_redaction(spark, odd, empty):
    docs = spark.createDataFrame([(1, "mail a@b.cc or +1 213 555 0199!", 31), (2, None, 0), (3, "clean", 5), (4, "192.168.0.1", 11)],
                                 "doc_id bigint, text string, n_chars bigint")
    rows = {r.doc_id: (r.text, r.n_chars) for r in redact(docs).collect()}
    assert rows == {1: ("mail [EMAIL] or [PHONE]!", 24), 2: (None, None), 3: ("clean", 5), 4: ("[IP]", 4)}
    assert redact(odd).columns == odd.columns and redact(odd).count() == odd.count()
    assert personal_data_digest(empty).collect() == []
