from __future__ import annotations

import hashlib
import re

import pyspark.sql.functions as F
import pytest

from sparkloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    out = [("email", m) for m in EMAIL.finditer(text)]
    out += [("ip", m) for m in IP.finditer(text) if all(int(p or 0) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


TEXTS = [
    "mail a.b@c.de, or x@y.z_q@r.st; ü\U0001f600 é@é no@no a@b@c.d user@host.co.uk. a@b..c",
    "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.0004 1.2.3 255.255.255.255x",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 378282246310005; 1 2 3 4 5",
    "+49 (30) 1234-567 +1 +12345678 +123456789 +1234567890123456 ++49 30 12345678.",
    "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, DE89370400440532013001",
]


def test_base_spans_equal_brute_force(make, odd):
    texts = TEXTS + [t for t in odd if not t or len(t) < 20_000]
    rows = pii.report(make(texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (texts[r.doc_id], want, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(f"{k}:") for k in pii.BASE]


def test_very_long_runs_do_not_break(make, odd):
    assert pii.report(make([t for t in odd if t and len(t) >= 20_000])).count() == 4


def test_iban_ends_where_its_country_says(make):
    texts = ["DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89370400440532013000 Bank", "GB82WEST12345698765432 I paid", "DE8937040044053201300", "XX89370400440532013000"]
    rows = {r.doc_id: r.spans for r in pii.report(make(texts)).collect()}
    found = [[texts[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in rows[i].split(",") if s) if k == "iban"] for i in range(5)]
    assert found == [["DE89 3704 0044 0532 0130 00"], ["DE89370400440532013000"], ["GB82WEST12345698765432"], [], []]


def test_iban_is_confirmed_by_mod_97(make):
    spans = pii.report(make(TEXTS)).where("doc_id = 4").first().spans
    assert [TEXTS[4][int(a) : int(b)] for k, a, b in (s.split(":") for s in spans.split(",")) if k == "iban"] == ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]


def test_context_raises_scores(make):
    near, far = pii.report(make(["card 4111111111111111", "4111111111111111"])).orderBy("doc_id").select("scored").collect()
    assert near[0][0]["score"] == pytest.approx(1.0) and far[0][0]["score"] == pytest.approx(0.9)


def test_redaction_replaces_spans_and_keeps_columns(make):
    docs = make(["to a@b.cd!", None, "nothing"])
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[0].text == "to [EMAIL]!" and out[0].n_chars == 11 and out[1].text is None and out[2].text == "nothing"
    assert pii.redact(docs).columns == docs.columns


def test_empty_table(make):
    assert pii.report(make(["a"]).where(F.lit(False))).count() == 0
