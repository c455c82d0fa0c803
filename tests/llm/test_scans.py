"""Personal data and secrets: planted cases, clean texts, the ledger."""

import hashlib
import random
import re
import time

import pyarrow.parquet as pq
import pytest
from common import AWKWARD, docs, records

from gleaner.llm import pii, secret_scan

FOUND = {
    "write to jane.doe+x@mail.example.co.uk.": [("email", "jane.doe+x@mail.example.co.uk")],
    "see https://a.example/b?c=1, or": [("url", "https://a.example/b?c=1")],
    "at 10.0.255.1 now": [("ip", "10.0.255.1")], "at 10.0.256.1 now": [], "v 1.2.3.4.5": [],
    "call +1 (826) 555-4081 96.153.118.61": [("phone", "+1 (826) 555-4081"), ("ip", "96.153.118.61")],
    "call (212) 555-1234 or +49 30 1234567.": [("phone", "(212) 555-1234"), ("phone", "+49 30 1234567")],
    "4111 1111 1111 1111 12": [("card", "4111 1111 1111 1111")], "4111111111111112": [],
    "GB DE89 3704 0044 0532 0130 00 END": [("iban", "DE89 3704 0044 0532 0130 00")], "DE88370400440532013000": [],
    "ssn 123-45-6789 and 000-12-3456": [("ssn", "123-45-6789")],
    "account no 12345678 but 12345678 alone later on in this text is none": [("account", "12345678")],
    "a @ b, @name, x@, @@, c@d": [], "3.14159 and 1,000,000 on 2024-01-02 10:30": [],
    "ab" * 9 + "@b.org": [("email", "ab" * 9 + "@b.org")],
}


@pytest.mark.parametrize("text", FOUND)
def test_pii_cases(text):
    assert [(k, text[s:e]) for k, s, e in pii.find(text, pii.automaton())] == FOUND[text]


def test_pii_awkward(spark):
    tail = [(20, "word " * 200_000 + "end@last.org", "a"), (21, None, None)]
    got = records(pii.findings(docs(spark, [*AWKWARD, *tail])), "doc_id", "kind", "start", "value")
    assert got == [(20, "email", 1_000_000, "end@last.org"), (None, "email", 19, "a@b.org")]
    assert pii.findings(docs(spark, []).limit(0)).count() == 0


def test_secrets_all_paths_and_rows(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    rows = [(x["doc_id"], x["text"], x["source"]) for x in t] + [(90_000 + i, x["text"], "copy") for i, x in enumerate(t)]
    rules = [(r.name, r.version, r.anchors, re.compile(r.pattern)) for r in secret_scan.RULES]
    want = sorted({(i, f"{s}/{i}", hashlib.sha256(x.encode()).hexdigest(), *f) for i, x, s in rows for f in secret_scan.scan_text(x, rules)}, key=repr)
    got = records(secret_scan.scan(docs(spark, rows)), "doc_id", "path", "blob", "rule", "version", "start", "end", "secret_sha256")
    assert got == want


def test_secret_awkward(spark):
    got = records(secret_scan.scan(docs(spark, AWKWARD)), "doc_id", "rule")
    assert got == [(8, "password_assignment")]
    assert secret_scan.scan(docs(spark, AWKWARD).limit(0)).count() == 0


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = secret_scan.Ledger(spark, str(tmp_path / "ledger"))
    first = docs(spark, [(1, "password = abcdefgh1", "s"), (2, "clean", "s")])
    old, new = secret_scan.RULES[:2], secret_scan.RULES
    assert records(secret_scan.scan(first, ledger, old), "doc_id") == [(1,)]
    pairs = lambda: sum(len(r.rules) for r in ledger.scanned().collect())
    assert pairs() == 4 and ledger.findings().count() == 1
    # a copy on another path is not scanned again, yet found; a new blob is
    second = docs(spark, [(3, "password = abcdefgh1", "t"), (4, "pwd: zyxwvuts9", "t")])
    assert records(secret_scan.scan(second, ledger, old), "doc_id", "path") == [(3, "t/3"), (4, "t/4")]
    assert pairs() == 6 and ledger.findings().count() == 2
    # new rules are tried on known blobs, old ones are not
    third = docs(spark, [(5, "password = abcdefgh1", "u")])
    assert records(secret_scan.scan(third, ledger, new), "doc_id", "rule") == [(5, "password_assignment")]
    assert pairs() == 6 + len(new) - len(old) and ledger.findings().count() == 2
    # all paths ever seen, by the ledger opened again
    assert records(secret_scan.Ledger(spark, ledger.path).report(), "doc_id", "path") == [(1, "s/1"), (3, "t/3"), (4, "t/4"), (5, "u/5")]
    # a run that broke off before its last table is made again
    ledger.findings().write.mode("append").parquet(f"{ledger.path}/findings")
    assert records(secret_scan.scan(third, ledger, new), "doc_id") == [(5,)] and ledger.report().count() == 4


def test_ledger_awkward(spark, tmp_path):
    ledger = secret_scan.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.report().count() == 0 and secret_scan.scan(docs(spark, AWKWARD).limit(0), ledger).count() == 0
    assert records(secret_scan.scan(docs(spark, AWKWARD), ledger), "doc_id", "rule") == [(8, "password_assignment")]
    assert records(secret_scan.scan(docs(spark, AWKWARD), ledger), "doc_id", "rule") == [(8, "password_assignment")]
    assert ledger.report().count() == 1


def test_two_batches_give_what_one_scan_gives(spark, tmp_path):
    columns = ("doc_id", "path", "blob", "rule", "version", "start", "end", "secret_sha256")
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ledger = secret_scan.Ledger(spark, str(tmp_path / "ledger"))
    got = []
    for part in ("doc_id % 2 = 0", "doc_id % 2 = 1"):
        got += records(secret_scan.scan(df.filter(part), ledger), *columns)
    want = records(secret_scan.scan(df), *columns)
    assert want and sorted(got, key=repr) == want == records(ledger.report(), *columns)
    assert records(secret_scan.query(spark, "/root/testdata/sf0.01"), *columns) == want


LONG = "".join(chr(97 + i * i % 23) for i in range(500))
KEY = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n" + "QUJD" * 16 + "\n-----END RSA PRIVATE KEY-----"
WHOLE = [
    *[(rule, before + LONG + after, LONG) for rule, before, after in (
        ("token_assignment", "token=", ""), ("token_assignment", "token        =    ", " x"), ("token_assignment", '{"api_key": "', '", "b": 1}'),
        ("token_assignment", "aws_secret_access_key = ", "\n"), ("token_assignment", r'{\"secret\": \"', r'\"}'), ("password_assignment", "password: ", " x"),
        ("password_assignment", '"db_password_old" : "', '"'), ("bearer_header", "Authorization: Bearer ", "\n"), ("url_credentials", "ftp://u:", "@h/x"), ("url_credentials", "ftp://" + LONG + ":", "@h/x"),
    )],
    ("git_token", f"x github_pat_{LONG} y", f"github_pat_{LONG}"), ("git_token", f"ghp_{LONG}", f"ghp_{LONG}"), ("chat_token", f"xoxb-{LONG}.", f"xoxb-{LONG}"),
    ("private_key", f"a {KEY} b", KEY), ("private_key", "-----BEGIN PRIVATE KEY-----\n" + "QUJD" * 16 + "\nand more", "-----BEGIN PRIVATE KEY-----\n" + "QUJD" * 16),
]


@pytest.mark.parametrize("rule, text, secret", WHOLE)
def test_secrets_are_taken_whole(rule, text, secret):
    rules = [(r.name, r.version, r.anchors, re.compile(r.pattern)) for r in secret_scan.RULES if r.name == rule]
    assert [(text[s:e], h) for _, _, s, e, h in secret_scan.scan_text(text, rules)] == [(secret, hashlib.sha256(secret.encode()).hexdigest())]


def test_secret_patterns_read_long_words_once():
    rules = [(r.name, r.version, r.anchors, re.compile(r.pattern)) for r in secret_scan.RULES]
    began = time.process_time()
    for word in ("token", "pwd_", "token ", "bearer ", "-----BEGIN PRIVATE KEY-----", "github_pat_", "a://b:c", "eyJ"):
        secret_scan.scan_text(word * 100_000, rules)
    assert time.process_time() - began < 60


CUED = {
    "passport C01X00T47": [("account", "C01X00T47")], "Reisepass L01X00T47, Berlin": [("account", "L01X00T47")], "policy no AB1234567.": [("account", "AB1234567")],
    "account GB12345678": [("account", "GB12345678")], "policy no AB-1234567 OF MAY": [("account", "AB-1234567")], "passport number: X1234567": [("account", "X1234567")],
    "Account holder, reference number of contract: 12345678": [("account", "12345678")],
    "account (tel +1 212 555-1234) 12345678": [("phone", "+1 212 555-1234"), ("account", "12345678")],
    "account opened on 2024-01-02 under 12345678 or 87654321": [("account", "12345678")],
    "Acct. No. of the holder that was named above: 12345678": [("account", "12345678")], "account 12345678901234567890": [("account", "12345678901234567890")],
    "we closed the account long before they came. After that 12345678 went": [], "accounting for all of the other things seen 12345678": [],
    "C01X00T47 and AB1234567": [], "account ABCDEFGH and USER_12345": [],
    "iban DE89 3704 0044 0532 0130 00 then 12345678": [("iban", "DE89 3704 0044 0532 0130 00")],
}


@pytest.mark.parametrize("text", CUED)
def test_numbers_after_a_cue(text):
    assert [(k, text[s:e]) for k, s, e in pii.find(text, pii.automaton())] == CUED[text]


def naive(text):
    """Every place of a text tried in turn, no automaton; addresses by one expression each."""
    mail = re.compile(r"@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")
    web = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s<>\"'`{}|\\^\[\]]+")
    cues = re.compile("|".join(re.escape(form) for cue in pii.CUES for form in {cue, cue.title(), cue.upper(), cue.capitalize()}))
    out, done, passed, cue, reach, meant = [], 0, -1, 0, -1, None
    for at in range(len(text)):
        for m in [m for size in {len(c) for c in pii.CUES} if at + 1 - size >= done and (m := cues.fullmatch(text, at + 1 - size, at + 1))]:
            if not re.match(r"(?:s|nummer|number|num|no|nr|id)?(?![^\W\d_])", text[at + 1 :], re.I):
                continue
            cue, reach, meant = at + 1, at + 1 + pii.NEAR, pii._MEANT.get(m.group().lower())
            if not text[max(0, m.start() - 1) : m.start()].isalnum():
                end = pii._CLAUSE_END.search(text, cue)
                reach = max(reach, end.start() if end else len(text))
        if at < done:
            continue
        if text[at] == "@":
            found = mail.match(text, at)
            local = re.sub(r".*\.\.", "", re.search(r"[A-Za-z0-9._%+'-]*$", text[:at]).group()) if found else ""
            local = re.sub(r"^[^A-Za-z0-9]+", "", local)
            if local and len(local) <= 64 and re.search(r"[A-Za-z0-9_%+]$", local) and at - len(local) >= done:
                out.append(("email", at - len(local), done := found.end()))
        elif text[at : at + 3] == "://":
            start = at
            while start > 0 and re.match(r"[A-Za-z0-9+.-]", text[start - 1]):
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            m = web.match(text, start) if start < at else None
            if m and text[at + 3].isalnum() and start >= done:
                out.append(("url", start, done := start + len(m.group().rstrip(".,;:!?)*"))))
        elif text[at] in "0123456789" and at > passed:
            got = pii.number_at(text, at, done, cue if at <= reach else None)
            if got:
                out.append(got)
                done = got[2]
                reach = -1 if got[0] in ("account", meant) else reach
            else:
                passed = re.compile(r"\w+").match(text, at).end() - 1
    return out


def test_pii_against_every_place_tried():
    rng = random.Random(9)
    texts = [x["text"] for x in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pylist() if len(x["text"]) < 5000]
    bits = [*FOUND, *CUED, "accountant saw 1234567", "Kontonummer 1234567", "bankkonto", " ", ", ", ". ", "\n", "a", "@", "..", "://", "x@y.org", "http://a.b/c", "7", "GB", "account ", "1234567"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    anchors = pii.automaton()
    found = 0
    for text in texts:
        got = pii.find(text, anchors)
        assert got == naive(text), text
        found += len(got)
    assert found > 1000


@pytest.mark.parametrize("text, want", [
    ("a" * 70 + "@b.org", []), ("a" * 64 + "@b.org", [("email", "a" * 64 + "@b.org")]), ("abcdefghijklmnopqrstuv://host.org/x y", [("url", "abcdefghijklmnopqrstuv://host.org/x")]),
    ("accountant saw 1234567", []), ("Kontonummer 1234567", [("account", "1234567")]), ("accounts: 1234567", [("account", "1234567")]), ("Bankkonto 1234567", [("account", "1234567")]), ("account12345678", [("account", "12345678")]),
])
def test_pii_whole_or_not_at_all(text, want):
    assert [(k, text[s:e]) for k, s, e in pii.find(text, pii.automaton())] == want


def test_pii_is_linear():
    began = time.process_time()
    for bit in ("://", "a://", "@", "a@", "a.", "1", "1 ", "account ", "GB", "+1 ", "..", "a@b."):
        pii.find(bit * (400_000 // len(bit)), pii.automaton())
    assert time.process_time() - began < 60
