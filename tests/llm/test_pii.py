import re

from hypothesis import given
from hypothesis import strategies as st

from graphloom.llm import pii
from graphloom.llm.queries import op4_pii
from tests.llm.helpers import SF, empty_docs, odd_docs, sha, texts


def base(text):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    passes = lambda d: sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(reversed(d))) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and passes(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_against_plain_expressions(spark):
    for r in zip(sorted(texts(spark)), sorted(tuple(r) for r in op4_pii(spark, SF).collect()), strict=True):
        (doc_id, text), (got, *counts, digest, spans, n_spans, scores) = r
        assert n_spans == len(scores) == (spans.count(",") + 1 if spans else 0) and all(0 <= x <= 1 for x in scores)
        want = base(text or "")
        kinds = [k for k, _, _ in want]
        assert got == doc_id and counts == [kinds.count(k) for k in pii.BASE] and digest == sha(joined(want)) and spans.startswith(joined(want))


@given(st.text(alphabet="aZ9@.+-% 4(\n0_é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == base(text)


def test_further_kinds():
    text = "IBAN GB82 WEST 1234 5698 7654 32, ssn 123-45-6789; 123-45-6789" + " x" * 40 + " 987-65-4321 token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""
    found = [(k, text[s:e]) for k, s, e, _ in pii.all_spans(text)]
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in found and ("national_id", "987-65-4321") not in found
    assert ("key", "04dbebab91ab85687d33eeaaf9ac699e1188f962") in found
    assert not pii.mod97("GB82WEST12345698765433") and pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_words_nearby_change_scores():
    iban, number = "GB82 WEST 1234 5698 7654 32", "123-45-6789"
    score = lambda text, kind: next((x for k, _, _, x in pii.all_spans(text) if k == kind), None)
    assert (score(f"x {iban} x", "iban"), score(f"bank {iban} x", "iban"), score(f"x {iban} example", "iban")) == (0.6, 0.9, None)
    assert score(f"bank example {iban}", "iban") == 0.6
    assert score(f"x {number}", "national_id") is None and score(f"ssn {number}", "national_id") == 0.8 and score(f"ssn {number} sample", "national_id") == 0.5
    for text, kind in ((" 4111111111111111 ", "card"), (" +1 (017) 555-7713 ", "phone"), (" 10.1.2.3 ", "ip")):
        plain, less = score(text, kind), score(f"version {text}", kind)
        more = score({"card": "visa", "phone": "call", "ip": "host"}[kind] + text, kind)
        assert less < plain < more <= 1  # and the span is there each time


def test_odd_rows_and_redaction(spark):
    docs = odd_docs(spark)
    assert pii.find_spans(docs, out="found").count() == docs.count()
    assert pii.find_spans(empty_docs(spark)).count() == 0
    one = spark.createDataFrame([("a.b@c.de and +1 (017) 555-7713 or 10.1.2.3.",), (None,), ("",)], "text string")
    assert [r[0] for r in one.select(pii.redact(one.text)).collect()] == ["[email] and [phone] or [ip].", None, ""]
