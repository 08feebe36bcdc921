"""Secrets and personal data against plain regular expressions."""

import hashlib
import random
import re
import time

import pytest

from recordlens.llm import pii, secrets
from recordlens.llm.automaton import Automaton

RULES = (*secrets.BASE, *secrets.MORE)
# The kinds as they are defined, written out again: pattern, group whose length counts, its least length, flags.
DEFINED = [
    (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, re.I | re.A),
    (r"AKIA[A-Z0-9]+", 0, 16, 0),
    (r"[0-9a-f]+", 0, 32, 0),
    (r"gh[pousr]_[A-Za-z0-9]+", 0, 40, 0),
    (r"xox[abprs]-[A-Za-z0-9-]+", 0, 15, 0),
    (r"AIza[A-Za-z0-9_-]+", 0, 39, 0),
    (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 36, 0),
    (r"-----BEGIN ([A-Z]+ ){0,3}PRIVATE KEY-----", 0, 1, 0),
]


def model_secrets(text):
    out = []
    for k, (pattern, group, least, flags) in enumerate(DEFINED):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
    return sorted(out)


def found_secrets(text):
    return secrets.spans(text.encode(), RULES, secrets.machine(RULES))


def test_automaton_gives_the_matches_of_the_expressions():
    rules = [("cab*", False), ("q?x[x-z]{2,3}", False), ("(foo|ba[rz])R", True), (r"\x41\.b{2}", False), (r"k[ab]+:c+", False)]
    automaton = Automaton(rules)
    plain = [re.compile(p.encode(), re.I if fold else 0) for p, fold in rules]
    rng = random.Random(1)
    for _ in range(4000):
        data = bytes(rng.choice(b"abcxyzqfoBAR.Akk::\xc3") for _ in range(rng.randrange(16)))
        got = [(s, k, e) for s, k, e, _ in automaton.scan(data)]
        for k in (0, 2, 3, 4):
            assert [x for x in got if x[1] == k] == [(m.start(), k, m.end()) for m in plain[k].finditer(data)], (data, rules[k])


def test_automaton_is_minimal_and_small():
    assert len(Automaton([("abc|abd|abe", False)]).rules[0].table) == 4
    assert secrets.machine(RULES).states < 5000
    for bad in ("a*", "ab|abcd", "[a-c]|x"):
        with pytest.raises(ValueError):
            Automaton([(bad, False)])


def test_secret_spans_match_the_rules():
    rng = random.Random(2)
    parts = ["password", "SECRET:", "token=", "api_key", "apikey ", "'", '"', " ", ":", "=", "abcdefgh", "0123456789abcdef", "AKIA", "ABCDEFGH1234", "deadbeef" * 4, "ghp_", "x" * 36,
             "é", "ſ", "K", "eyJabcdefgh", ".", "-", "\n", "xoxb-", "AIza", "y" * 35, "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE ", "eyJ" + "z" * 30, "passwd:"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert found_secrets(text) == model_secrets(text), text


def test_a_short_match_uses_up_its_text():
    assert found_secrets("token: token: abcdefgh1") == []
    assert [k for _, k, _ in found_secrets("token: abcdefgh1")] == [0]
    text = "token=abcsecret :footoken=barbarbar"
    assert found_secrets(text) == model_secrets(text) == [(0, 0, 15), (20, 0, 35)]


def test_long_runs_take_one_pass():
    for text in ("a" * 1_000_000, "eyJ" * 300_000, "eyJa.eyJb" * 100_000, "token" * 200_000, "token " + " " * 500_000, "AKIA" * 250_000):
        began = time.time()
        found_secrets(text)
        assert time.time() - began < 2


def test_secret_scan_rows(spark):
    rows = [(1, None), (2, ""), (3, "é password = hunter2hunter2"), (3, "é password = hunter2hunter2"), (None, "x" * 300_000 + " AKIAABCDEFGH12345 "), (4, "deadbeef" * 5)]
    got = secrets.scan(spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, spans string")).collect()
    assert sorted((str(r["doc_id"]), r["n_assign"], r["n_access"], r["n_hex"]) for r in got) == [("1", 0, 0, 0), ("2", 0, 0, 0), ("3", 1, 0, 0), ("3", 1, 0, 0), ("4", 0, 0, 1), ("None", 0, 1, 0)]
    three = next(r for r in got if r["doc_id"] == 3)
    assert three["spans"] == "assign:2:27" and three["base_sha256"] == hashlib.sha256(b"assign:2:27").hexdigest()
    assert next(r for r in got if r["doc_id"] == 1)["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def luhn_of(prefix):
    return next(prefix + d for d in "0123456789" if pii.luhn(prefix + d))


def model_pii(text):
    out = []
    # The kinds by contract, written out again.
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]
    for k, (kind, p) in enumerate(kinds):
        for m in re.finditer(p, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card":
                doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits[::-1])]
                if not 14 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_the_rules():
    rng = random.Random(3)
    parts = ["a.b", "@", "x-y.org", ".", "10.0.0.1", "999.1.1.1", "1.2.3.4.5.6.7.8", luhn_of("453201511283036"), "4532 0151 1283 0366", " ", "-", "+1 (555) 123-4567", "+", "é", "００", "7", "\n", "iban", "12345678901234", "@", "..", "%", "me", "256.", "0", "(", ")", "+4"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        got = pii.spans(text)
        assert [x for x in got if x[1] < 4] == model_pii(text)


def test_added_kinds_need_a_checksum_or_context():
    kinds = lambda t: [pii.KINDS[k] for _, k, _ in pii.spans(t)]
    assert kinds("pay to GB82 WEST 1234 5698 7654 32 now") == ["iban"]
    assert kinds("pay to GB82 WEST 1234 5698 7654 33 now") == []
    assert kinds("his SSN is 123-45-6789") == ["ssn"] and kinds("order 123-45-6789") == [] and kinds("ssn 000-45-6789") == []
    assert kinds("call 555-123-4567 today") == ["local_phone"] and kinds("555-123-4567") == []
    assert kinds("call order 555-123-4567") == []


def test_pii_rows_and_redaction(spark):
    rows = [(1, None), (2, ""), (3, "ñ me@x.org, 10.0.0.1"), (None, "a" * 200_000 + "@x.org")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_email int")
    got = {r["doc_id"]: r for r in pii.scan(df).collect()}
    assert got[3]["spans"] == "email:2:10,ip:12:20" and (got[3]["n_email"], got[3]["n_ip"]) == (1, 1) and got[None]["n_email"] == 1
    assert got[1]["spans"] == got[2]["spans"] == ""
    assert {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}[3] == "ñ [email], [ip]"
    assert pii.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("run", ["7", "a", "1.", "a.", "@", "a@", "a@b.", "+1", "1 ", "+1 (", "AB12", "12-", "1.2.3.4 ", "555-123-4567 call "])
def test_a_megabyte_of_one_run_is_quick(run):
    text = run * (1_000_000 // len(run))
    began = time.time()
    for t in (text, text + "@", "@" + text):
        pii.spans(t)
    assert time.time() - began < 6
