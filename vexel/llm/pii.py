"""Personal data: expressions propose spans, checksums confirm them, context words adjust the score. DataFrame functions only.

Each kind's expression marks its leftmost non-overlapping matches with a sentinel, splitting at it gives alternating gaps and
matches, and running lengths give their places in code points. Expressions are written so that Java's matcher needs no
recursion and no backtracking over long runs: separators that join two characters of a match are first replaced, one for
one, by private sentinels, after which each kind is a run of one character class.

Base kinds: email, ip (parts at most 255), card (14 to 19 digits, Luhn), phone (``+``, 10 to 15 digits). The method adds
iban (mod-97), and, where context words stand before them, ssn, phones without ``+`` and cards of 12 or 13 digits. Every
span has a score: a prior by kind, raised by whole context words within the ``WINDOW`` characters before it; added spans need
``THRESHOLD``. Base spans stay whatever their score.

Defined results: null texts count as empty; sentinels in a text (U+0001 to U+0005) are read as another control
character, which changes no match; texts of any length are searched whole; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.functions.vectors import let

WINDOW = 40
THRESHOLD = 0.7
_S, _SPACE, _DASH, _DOT = "\x01", "\x03", "\x04", "\x05"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # over the text with joined separators
    prior: float
    words: str  # context words that raise the score
    base: bool


#: In the order of their names in digests: base kinds, then added ones.
KINDS = (
    Kind("email", rf"(?:(?<![A-Za-z0-9._%+{_DASH}{_DOT}-])|\G)[A-Za-z0-9._%+{_DASH}{_DOT}-]++@[A-Za-z0-9{_DASH}-]++{_DOT}[A-Za-z0-9{_DASH}{_DOT}-]*+", 0.9, "e?mails?|contact|write|kontakt|courriel|correo", True),
    Kind("ip", rf"(?<![0-9])[0-9]++{_DOT}[0-9]++{_DOT}[0-9]++{_DOT}[0-9]++", 0.6, "ip|address|host|server|login", True),
    Kind("card", rf"[0-9][0-9{_SPACE}{_DASH}]++", 0.8, "(?:credit|kredit)?(?:cards?|karten?)|visa|master(?:card)?|amex|credit|carte|tarjeta", True),
    Kind("phone", rf"\+[0-9][\x20{_SPACE}{_DASH}{_DOT}().0-9-]+[0-9]", 0.8, "tele?(?:phone?|fon)?|telefone|t[eé]l[eé]phone|phones?|call|mobile|mobil|fax|(?:an)?ruf(?:nummer)?", True),
    Kind("iban", rf"(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?:[\x20{_SPACE}]?[A-Z0-9]{{4}}){{2,7}}(?:[\x20{_SPACE}]?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9])", 0.7, "iban|account|konto|compte|cuenta|bank", False),
    Kind("ssn", rf"(?<![0-9{_DASH}{_DOT}])[0-9]{{3}}{_DASH}[0-9]{{2}}{_DASH}[0-9]{{4}}(?![0-9{_DASH}{_DOT}])", 0.4, "ssn|social|security", False),
    Kind("local_phone", rf"(?<![0-9+{_SPACE}{_DASH}{_DOT}])0[0-9]{{2,4}}[{_SPACE}{_DASH}][0-9]{{3,4}}(?:[{_SPACE}{_DASH}][0-9]{{2,4}})?(?![0-9{_SPACE}{_DASH}{_DOT}])", 0.4, "tele?(?:phone?|fon)?|telefone|t[eé]l[eé]phone|phones?|call|mobile|mobil|fax|(?:an)?ruf(?:nummer)?", False),
    Kind("short_card", rf"[0-9][0-9{_SPACE}{_DASH}]++", 0.4, "(?:credit|kredit)?(?:cards?|karten?)|visa|master(?:card)?|amex|credit|carte|tarjeta", False),
)


def prepared(text: Column) -> Column:
    """The text with sentinels taken out and joining separators marked; as many code points as before."""
    t = F.translate(F.coalesce(text, F.lit("")), _S + _SPACE + _DASH + _DOT, "\x02" * 4)
    t = F.regexp_replace(t, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)
    t = F.regexp_replace(t, r"(?<=[0-9]) (?=[0-9])", _SPACE)
    return F.regexp_replace(t, r"(?<=[0-9])-(?=[0-9])", _DASH)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The Luhn checksum of a string of digits: every second digit from the right counts double, its digits summed."""
    n = F.length(number)

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 0, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.split(number, ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 7064 mod 97-10: the first four characters go last, letters count 10 to 35, the remainder is 1."""
    plain = F.regexp_replace(iban, "[^A-Z0-9]", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def confirmed(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return m.rlike(f"^{part}(?:{_DOT}{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(m))).otherwise(False)
    if kind == "short_card":
        return F.when(n.between(12, 13), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(m, "[^A-Z0-9]", "")).between(15, 34) & mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)")
    if kind == "local_phone":
        return n.between(9, 12)
    return F.lit(True)


_SPAN = "struct<start:bigint,rank:int,kind:string,finish:bigint,score:double>"


def kind_spans(text: Column, rank: int, kind: Kind) -> Column:
    """array of (start, rank, kind, finish, score) for one kind over a prepared text.

    The parts are folded in runs of about the square root of their number, and the runs then: an array that grows is copied at each
    step, so a single fold would cost the square of the number of matches.
    """
    parts = F.split(F.regexp_replace(text, f"({kind.pattern})", f"{_S}$1{_S}"), _S, -1)
    # Split gives gap, match, gap, match, ..., gap: element 2i is a gap, 2i+1 a match; a run has an even number of elements.
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    context = rf"(?<![\p{{L}}\p{{N}}])(?:{kind.words})(?![\p{{L}}\p{{N}}])"

    def state(at: Column, before: Column, i: Column, out: Column) -> Column:
        return F.struct(at.alias("at"), before.alias("before"), i.alias("i"), out.alias("out"))

    def step(acc: Column, p: Column) -> Column:
        n, at, match = F.length(p).cast("bigint"), acc.getField("at"), acc.getField("i") == 1
        score = F.least(F.lit(kind.prior) + F.when(F.lower(acc.getField("before")).rlike(context), 0.4).otherwise(0.0), F.lit(1.0))
        ok = confirmed(kind.name, p) if kind.base else confirmed(kind.name, p) & (score >= THRESHOLD)
        span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (at + n).alias("finish"), score.alias("score"))
        out = F.concat(acc.getField("out"), F.when(match & ok, F.array(span)).otherwise(none))
        return state(at + n, F.right(F.concat(acc.getField("before"), F.right(p, F.lit(WINDOW))), F.lit(WINDOW)), 1 - acc.getField("i"), out)

    def fold(parts: Column) -> Column:
        run = (F.ceil(F.sqrt(F.size(parts)) / 2) * 2).cast("int")
        begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("before"), F.expr(f"cast(array() as array<array<{_SPAN}>>)").alias("runs"))

        def one(acc: Column, k: Column) -> Column:
            start = state(acc.getField("at"), acc.getField("before"), F.lit(0), none)
            done = F.aggregate(F.slice(parts, k * run + 1, run), start, step)
            return let(done, lambda d: F.struct(d.getField("at").alias("at"), d.getField("before").alias("before"), F.concat(acc.getField("runs"), F.array(d.getField("out"))).alias("runs")))

        runs = F.sequence(F.lit(0), F.ceil(F.size(parts) / run).cast("int") - 1)
        return F.flatten(F.aggregate(runs, begin, one, lambda acc: acc.getField("runs")))

    return let(parts, lambda parts: F.when(F.size(parts) > 1, fold(parts)).otherwise(none))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<start, rank, kind, finish, score>>) sorted by start, then kind order. A narrow plan: no shuffle, no Python."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    # Only texts with a digit or an at sign are prepared at all, only those with the sign a kind needs are searched for it.
    rows = rows.select("id", F.when(F.col("t").rlike("[0-9@]"), prepared(F.col("t"))).otherwise(F.lit("")).alias("p"))
    needs = {"email": r"@", "ip": f"[0-9]{_DOT}[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "iban": f"[A-Z]{{2}}[0-9]{{2}}[\\x20{_SPACE}]?[A-Z0-9]{{4}}", "ssn": f"{_DASH}[0-9]{{2}}{_DASH}", "local_phone": f"0[0-9]{{2,4}}[{_SPACE}{_DASH}]", "short_card": "[0-9]"}
    each = [F.when(F.col("p").rlike(needs[k.name]), kind_spans(F.col("p"), i, k)).otherwise(none) for i, k in enumerate(KINDS)]
    return rows.select("id", F.array_sort(F.concat(*each)).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.getField("kind"), s.getField("start").cast("string"), s.getField("finish").cast("string"))), ",")


def only(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s.getField("kind").isin(*kinds))
