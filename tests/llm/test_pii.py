import hashlib
import re

from takewise.llm import pii

from .common import ODD, clashing, empty, odd, rows

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return sorted((m.start(), list(BASE).index(k), m.end(), k) for k, rx in BASE.items() for m in re.finditer(rx, text or "") if good(k, m.group()))


TEXTS = [
    "mail a@b.c_d@e.f or x.y+z@mail-1.example.co.uk. ip 10.0.0.1, 300.1.1.1 1.2.3.4.5.6.7.8 000255.1.1.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 79927398713 and 4699065906345690",
    "+1 (766) 555-2373, +49 30 123456 +1 2 ++12345678901234567890 é😀 +33 1 23 45 67 89",
    "0" * 5000, "1 " * 3000, "a" * 30_000 + "@b.c", "a.b@c " * 200, "@" * 3000, "1." * 3000, "+1" + "(" * 3000, "1.2.3.4" * 500,
    "x@y.z1.2.3.4 4111111111111111", "€ iban DE89 3704 0044 0532 0130 00, GB82WEST12345698765432; DE88370400440532013000", "ssn 078-05-1120 but not 078-05-1120",
    "key " + "AKIA" + "Q7" * 8 + ' token = "' + "3f" * 20 + '" api_key: abcd-1234 password: short nothing',
]


def test_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
    for i, text in enumerate(TEXTS):
        base = [(s.start, list(BASE).index(s.kind), s.end, s.kind) for s in got[i] if s.kind in BASE]
        assert base == brute(text), text[:60]
        assert all(text[s.start : s.end] == s.value and 0 <= s.score <= 1 for s in got[i])


def test_added_kinds_and_context(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
    assert [s.value for s in got[12] if s.kind == "iban"] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert [s.start for s in got[13] if s.kind == "ssn"] == [4, 24]  # context reaches over other matches
    assert [(s.kind, s.value) for s in got[14]] == [("token", "AKIA" + "Q7" * 8), ("secret", 'token = "' + "3f" * 20), ("secret", "api_key: abcd-1234")]
    far = spark.createDataFrame([(1, "ssn " + "word " * 20 + "078-05-1120")], "doc_id long, text string")
    assert pii.find_personal_data(far).first().spans == []


def test_digest_and_odd_rows(spark):
    got = {r.doc_id: r for r in pii.digest(pii.find_personal_data(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))).collect()}
    for i, text in enumerate(TEXTS):
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute(text))
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
    assert pii.digest(pii.find_personal_data(odd(spark))).count() == len(ODD)
    assert rows(pii.digest(pii.find_personal_data(clashing(spark)))) == rows(pii.digest(pii.find_personal_data(odd(spark))))
    assert pii.find_personal_data(empty(spark)).count() == 0


def test_redact(spark):
    df = spark.createDataFrame([(1, "mail a@b.c now 10.0.0.1!"), (2, None)], "doc_id long, text string")
    assert rows(pii.redact(df)) == [(1, "mail [email] now [ip]!"), (2, "")]


def test_native_plan(spark, sf):
    plan = pii.find_personal_data(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)
