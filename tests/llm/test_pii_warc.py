"""Personal data against plain regular expressions; web archives against a direct computation."""

import hashlib
import re

import numpy as np

from telewatch.llm import pii, warc
from telewatch.sources.tables import materialise

PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub("[ -]", "", s)) <= 19 and pii.luhn(re.sub("[ -]", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def plain(text):
    return [(k, *m.span()) for k, (p, right) in PLAIN.items() for m in re.finditer(p, text) if right(m.group())]


def test_base_spans_equal_the_plain_patterns():
    rng = np.random.default_rng(5)
    for alphabet in ("ab@..-1 ", "12.. ", "4 -012345678", "+1 ()-.5a", "ab.@+12 -()"):
        for _ in range(3000):
            t = "".join(rng.choice(list(alphabet), 45))
            assert [(k, a, b) for k, a, b, _ in pii.find(t) if k in pii.BASE] == plain(t)


def test_more_kinds_need_checksum_or_context():
    kinds = lambda t: {k for k, *_ in pii.find(t)}
    assert "iban" in kinds("pay to DE89 3704 0044 0532 0130 00 now") and "iban" not in kinds("pay to DE88 3704 0044 0532 0130 00 now")
    assert "ssn" in kinds("his ssn is 123-45-6789.") and "ssn" not in kinds("it costs 123-45-6789.")
    key = "0123456789abcdef0123456789abcdef"
    assert "secret" in kinds(f'token = "{key}"') and "secret" not in kinds(f"md5 {key}") and "secret" not in kinds(f"see {key}")


def test_an_iban_ends_where_its_country_says():
    spans = lambda t: [t[a:b] for k, a, b, _ in pii.find(t) if k == "iban"]
    german, british = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    for after in ("", " BIC: COBADEFF", " I paid", " 2024", " A B C D E F G H I J K L M N", ", 2024", " ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        for n in (german, german.replace(" ", ""), british):
            assert spans(f"to {n}{after}") == [n]
    assert spans(f"{german} {british} NO93 8601 1117 947 X") == [german, british, "NO93 8601 1117 947"]
    assert spans(f"REF1 DE88 {british}") == [british]
    assert spans("DE88 3704 0044 0532 0130 00 BIC") == [] and spans("DE89370400440532013000I") == []
    other = next(f"ZZ{c:02d} 1234 5678 9012 3456" for c in range(98) if pii.mod97(f"ZZ{c:02d}1234567890123456"))  # no listed length
    assert spans(f"{other} I") == [other]
    text = f"to {german} BIC: COBADEFF"
    assert pii.mask(text, pii.find(text)) == "to [IBAN] BIC: COBADEFF"


def test_context_on_both_sides():
    spans = lambda t: {k: s for k, _, _, s in pii.find(t)}
    assert spans("123-45-6789 is my social security number") == {"ssn": 0.6}
    key = "0123456789abcdef0123456789abcdef"
    assert spans(f"{key} is the api key") == {"secret": 0.6} and spans(f"{key} is the md5 of the key") == {}
    assert spans("ssn 123-45-6789, order 7") == {"ssn": 0.6} and spans("order 123-45-6789") == {}


def test_long_runs_take_linear_time():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+1" + "(" * 200_000, "@" * 100_000, "a@" * 100_000):
        pii.find(t)


def test_report_and_redaction(documents):
    texts = [None, "", "mail bob@mail.example.com or é +1 (017) 555-7713", "ip 10.0.0.1 and 999.1.1.1", "card 4845168114407329 x", "none"] * 2
    rows = sorted(pii.report(documents(texts)).collect())
    for r, t in zip(rows, texts):
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(t or ""))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in plain(t or "")) for k in pii.BASE)
    out = sorted(map(tuple, pii.redact(documents(texts)).collect()))
    assert [r[1] for r in out][:4] == [None, "", "mail [EMAIL] or é [PHONE]", "ip [IP] and 999.1.1.1"]
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in out)
    assert pii.report(documents([])).collect() == [] and pii.redact(documents([])).collect() == []


PAGES = "page_id long, url string, html string, payload string"


def test_captures(spark):
    big, other = "<p>é" * 60, "<b>" * 50
    rows = [(5, "http://a/é?x=1\r\nX: y", big), (2, None, big), (9, "u", big), (1, "u", "small"), (3, "u", "small"), (4, "v", None), (7, "w", other),
            (8, "w", ""), (2, None, big), (6, "line\r\n\r\nWARC/1.1", "WARC/1.1\r\n\r\n" * 30)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], PAGES).repartition(3)
    got = sorted(tuple(r)[:5] for r in warc.captures(pages).collect())
    want = []
    for p, _, html in rows:
        payload = (html or "").encode()
        first = min(q for q, _, h in rows if (h or "") == (html or ""))
        again = len(payload) >= 100 and first != p
        want.append((p, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first if again else None))
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_null_ids_and_payloads_of_archives(spark):
    big = "z" * 200
    pages = spark.createDataFrame([(None, "u", big, ""), (4, "u", big, ""), (None, None, None, "")], PAGES)
    records = materialise(warc.read_archives(warc.write_archives(pages)), "records")
    payloads = sorted(bytes(r.payload) for r in records.filter("kind = 'response'").collect())
    assert payloads == [b"", big.encode()]
    rows = warc.assemble(records).collect()
    assert sorted((r.kind, str(r.refers_to)) for r in rows) == [("response", "None"), ("response", "None"), ("revisit", "4")]
    assert warc.captures(spark.createDataFrame([], PAGES)).collect() == []
