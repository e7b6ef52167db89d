import hashlib
import random
import re

from tests.llm.helpers import docs_dir, frame
from vexel.llm import pii
from vexel.llm.queries import op4_pii

KINDS = ["email", "ip", "card", "phone"]


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def brute(t):
    dig = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(dig(m[0])) <= 19 and luhn(dig(m[0]))]
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(dig(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def card(r, n):
    d = "".join(r.choices("0123456789", k=n - 1))
    return next(d + c for c in "0123456789" if luhn(d + c))


def texts():
    r = random.Random(4)
    parts = ["a", "b.c", "@", "@x.y", "_", "é", "中🙂", " ", "  ", ".", "-", "--", "+", "+4", "(0)", "12", "255", "256", "0001", "1.2.3.4", ".5", "\n", "%", "\x01", "\x05", "\x03", "4 5", "9-9", "foo@bar.com", "+49 30 1234567"]
    out = ["", None, "1 " * 30_000, "a.a" * 20_000, "a" * 100_000 + "@", "+1" + "(" * 50_000, "x@" + "y." * 20_000 + "z", "1-2.3 4" * 9000]
    out += ["".join(r.choices(parts, k=r.randint(0, 16))) for _ in range(3000)]
    for _ in range(300):
        c = card(r, r.randint(12, 20))
        out.append(f"é my {r.choice(['card', 'x'])}: " + r.choice(["", " ", "-"]).join([c[:4], c[4:8], c[8:12], c[12:]]).strip(" -") + " end")
    return out


def test_base_spans_match_regular_expressions(spark, tmp_path):
    t = texts()
    df = op4_pii(spark, docs_dir(spark, tmp_path, frame(spark, t)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    out = {x.doc_id: x for x in df.collect()}
    for i, x in enumerate(t):
        want = brute(x or "")
        assert [s for s in out[i].spans.split(",") if s.split(":")[0] in KINDS] == [f"{k}:{a}:{b}" for a, b, k in want], repr(x)[:200]
        assert out[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in KINDS] == [sum(w[2] == k for w in want) for k in KINDS]


def test_added_kinds_need_checks_and_context(spark):
    t = ["IBAN DE89370400440532013000.", "IBAN DE89370400440532013001.", "GB82WEST12345698765432 x", "ssn 123-45-6789", "order 123-45-6789", "call 030-1234-567 now", "part 030-1234-567 now"]
    out = {r.id: [s.kind for s in r.spans] for r in pii.find_pii(frame(spark, t)).collect()}
    assert out == {0: ["iban"], 1: [], 2: ["iban"], 3: ["ssn"], 4: [], 5: ["local_phone"], 6: []}
    a, b = (pii.find_pii(frame(spark, [x])).first().spans[0].score for x in ("my card 4111111111111111", "no. 4111111111111111"))
    assert a > b
    assert pii.find_pii(frame(spark, [])).count() == 0


def test_context_reaches_past_matches_of_the_same_kind(spark):
    texts = ["Visa card, exp 12/27, 4222222222222", "SSN: 123-45-6789, 234-56-7890", "Visa card " + "x" * 40 + " 12/27, 4222222222222"]
    got = {r.id: r.spans for r in pii.find_pii(frame(spark, texts)).collect()}
    assert [(s.kind, s.start) for s in got[0]] == [("short_card", 22)]
    assert [(s.kind, s.start) for s in got[1]] == [("ssn", 5), ("ssn", 18)]
    assert got[2] == []
    a, b = pii.find_pii(frame(spark, ["card 4111111111111111, 5500005555555559"])).first().spans
    assert a.score == b.score == 1.0


def test_context_words_are_whole_words(spark):
    texts = ["hotel 030-1234-567", "discard 4222222222222", "Telefon: 030-1234-567", "tel. 030-1234-567", "cards 4222222222222", "card4 x 4222222222222"]
    assert {r.id: [s.kind for s in r.spans] for r in pii.find_pii(frame(spark, texts)).collect()} == {0: [], 1: [], 2: ["local_phone"], 3: ["local_phone"], 4: ["short_card"], 5: []}


def test_grouped_ibans(spark):
    texts = ["pay DE89 3704 0044 0532 0130 00 now", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 01", "NO93 8601 1117 947", "xDE89 3704 0044 0532 0130 00"]
    got = {r.id: [(s.kind, s.start, s.finish) for s in r.spans if s.kind == "iban"] for r in pii.find_pii(frame(spark, texts)).collect()}
    assert got == {0: [("iban", 4, 31)], 1: [("iban", 0, 27)], 2: [], 3: [("iban", 0, 18)], 4: []}


def test_many_matches_in_one_text(spark):
    """Places stay right over many runs of parts; the time grows far less than with the square (a fold in one run takes minutes here)."""
    n = 60_000
    spans = pii.find_pii(frame(spark, ["é1.2.3.4 " * n])).first().spans
    assert [(s.kind, s.start, s.finish) for s in spans] == [("ip", 9 * i + 1, 9 * i + 8) for i in range(n)]


def test_null_ids_and_repeats_keep_their_rows(spark):
    out = pii.find_pii(frame(spark, ["a@b.c", "a@b.c", None], ids=[None, 3, 3])).collect()
    assert sorted((str(r.id), len(r.spans)) for r in out) == [("3", 0), ("3", 1), ("None", 1)]
