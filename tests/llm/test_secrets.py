import hashlib
import random
import re

import pytest

from tests.llm.helpers import docs_dir, frame
from vexel.llm import automaton, secrets
from vexel.llm.queries import op10_secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KINDS = ["assign", "access", "hex"]


def brute(t):
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def texts():
    r = random.Random(1)
    parts = ["password", "Token", "secret", "api_key", "APIKEY", "passwd", " ", "  ", "=", ":", '"', "'", "abc", "deadbeef", "0123", "AKIA", "ABCDEFGH12", "é", "中", "\n", "x", "_", ".", "f" * 20, "Z" * 15, "token=token: abcdef"]
    return ["", None, "ghp_" + "a1B2" * 9, "f" * 100_000, "é " * 5000 + "secret = 'hunter22'"] + ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(3000)]


def test_base_spans_match_regular_expressions(spark, tmp_path):
    t = texts()
    out = {x.doc_id: x for x in op10_secrets(spark, docs_dir(spark, tmp_path, frame(spark, t))).collect()}
    for i, x in enumerate(t):
        want = brute(x or "")
        assert out[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()
        assert [out[i].n_assign, out[i].n_access, out[i].n_hex] == [sum(w[2] == k for w in want) for k in KINDS]
        assert [s for s in out[i].spans.split(",") if s.split(":")[0] in KINDS] == [f"{k}:{a}:{b}" for a, b, k in want]
    assert "github:0:40" in out[2].spans


def test_all_rules_from_one_pass_equal_a_pass_of_re_each():
    scan, r = secrets.scanner(), random.Random(12)
    parts = ["ghp_", "gho_" + "a" * 36, "xoxb-", "1-a2-", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "eyJ", "abc_-", ".", "AIza", "x" * 35, "AKIA", "Q" * 16, "0f" * 12, "token", "=", " ", "é"]
    for _ in range(4000):
        t = "".join(r.choices(parts, k=r.randint(1, 16)))
        want = []
        for i, rule in enumerate(secrets.RULES):
            for m in re.finditer(rule.pattern, t, re.I if rule.ignore_case else 0):
                if rule.keep(m[0].encode()):
                    want.append((m.start(), i, m.end()))
        assert scan.spans(t.encode()) == [(a, b, secrets.RULES[i].kind) for a, i, b in sorted(want)], t


def test_empty_table_repeats_and_null_ids(spark):
    assert secrets.find_secrets(frame(spark, [])).count() == 0
    out = secrets.find_secrets(frame(spark, ["token=abcdef"] * 3, ids=[None, 2, 2])).collect()
    assert sorted(str(x.id) for x in out) == ["2", "2", "None"] and {x.spans for x in out} == {"assign:0:12"}


@pytest.mark.parametrize("pattern", ["(ab|a)c?d{2,3}", "a[^b-d]+e", "(x|yz)*w", r"\x41\.[0-9]{2}"])
def test_automaton_agrees_with_re(pattern):
    dfa, r = automaton.compile_rules([automaton.parse(pattern)], False), random.Random(2)
    for _ in range(4000):
        s = "".join(r.choices("abcdexyzwA.09", k=r.randint(1, 8)))
        at, ok = 0, False
        for c in s.encode().translate(dfa.classes):
            at = dfa.table[at + c]
        ok = at >= dfa.accepting
        assert ok == bool(re.fullmatch(pattern, s))


def test_redaction_keeps_rows_and_columns(spark):
    df = frame(spark, ["my token = abcdef123 é", None, "clean", ""])
    out = sorted(secrets.redact(df).collect(), key=lambda x: x.doc_id)
    assert [x.text for x in out] == ["my [SECRET] é", None, "clean", ""] and out[0].n_chars == len(out[0].text)
    assert out[0].asDict().keys() == df.first().asDict().keys() and secrets.redact(frame(spark, [])).count() == 0
