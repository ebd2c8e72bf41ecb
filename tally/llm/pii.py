"""Format-preserving pseudonyms for personal data.  DataFrame operations only.

Candidates are found by pattern and validated (check digits, ranges, calendar).
A valid value is replaced by another valid value of the same format through a
keyed Feistel network on the format's own domain: a permutation, so equal
values get equal pseudonyms in every document and different values different
ones, with no table of values and no shuffle.  Invalid candidates stay.

A number's domain is Z_a x Z_b; each round adds a keyed hash of one half to the
other, modulo a or b, so the result never leaves the domain.  Letters and
digits of an e-mail name, an account number or an access key are permuted as two
halves of characters, each within its own class (a-z, A-Z, 0-9).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31, as 17 x 4297.
DAY_A, DAY_B = 17, 4297
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _int(x: Column) -> Column:
    return x.cast("bigint")


def _hash(key: str, *parts) -> Column:
    """60 bits of a keyed SHA-256."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def permute_pair(key: str, tag: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """The keyed permutation of (left, right) in Z_a x Z_b, as a struct."""
    start = F.struct(_int(left).alias("l"), _int(right).alias("r"), _int(a).alias("a"), _int(b).alias("b"))

    def turn(s, i):
        odd = i % 2 == 1
        l = F.when(odd, F.pmod(s["l"] + _hash(key, F.lit(tag), i, s["r"], s["a"], s["b"]) % s["a"], s["a"])).otherwise(s["l"])  # noqa: E741
        r = F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + _hash(key, F.lit(tag), i, s["l"], s["a"], s["b"]) % s["b"], s["b"]))
        return F.struct(l.alias("l"), r.alias("r"), s["a"].alias("a"), s["b"].alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def permute_digits(key: str, tag: str, digits: Column) -> Column:
    """The permutation of the digit strings of a length (2 to 36 digits)."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10), k).cast("bigint")
    got = permute_pair(key, tag, F.substr(digits, F.lit(1), h), F.substr(digits, h + 1), ten(h), ten(n - h))
    return F.transform(F.array(got), lambda p: F.concat(F.lpad(p["l"].cast("string"), h, "0"),
                                                        F.lpad(p["r"].cast("string"), n - h, "0")))[0]


def permute_text(key: str, tag: str, value: Column) -> Column:
    """The permutation of a string in which every letter stays a letter of its
    case, every digit a digit and everything else where it is."""
    h = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), h).alias("l"), F.substr(value, h + 1).alias("r"))

    def shifted(own, other, i):
        def one(c, j):
            # 15 hexadecimal digits (60 bits) for each character
            by = _hash(key, F.lit(tag), i, j, F.length(own), other)
            out = c
            for letters in (LOWER, UPPER, DIGITS):
                at = F.instr(F.lit(letters), c)
                out = F.when((at > 0) & (c != ""), F.substr(
                    F.lit(letters), (F.pmod(at - 1 + by % len(letters), F.lit(len(letters))) + 1).cast("int"), F.lit(1))
                ).otherwise(out)
            return out
        return F.array_join(F.transform(F.split(own, ""), one), "")

    def turn(s, i):
        odd = i % 2 == 1
        return F.struct(F.when(odd, shifted(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"),
                        F.when(odd, s["r"]).otherwise(shifted(s["r"], s["l"], i)).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a digit string, its check digit included."""
    n = F.length(digits)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.transform(F.array(
        F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)),
        lambda x: F.when(x > 9, x - 9).otherwise(x))[0]) % 10


def _mod97(text: Column) -> Column:
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(
        F.instr(F.lit(DIGITS), c) > 0, (a * 10 + c.cast("int")) % 97).otherwise(
        (a * 100 + F.instr(F.lit(UPPER), c) + 9) % 97))


def _refill(shape: Column, chars: Column, places: str = DIGITS) -> Column:
    """``shape`` with its digits (or other ``places``) replaced, in order, by ``chars``."""
    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
                       lambda a, c: F.when(F.instr(F.lit(places), c) > 0, F.struct(
                           F.concat(a["out"], F.substr(chars, a["i"], F.lit(1))).alias("out"), (a["i"] + 1).alias("i")))
                       .otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i"))), lambda a: a["out"])


def _only_digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[^0-9]", "")


#: Groups of a candidate that are cut in one go.
CUT_BLOCK = 500


def _cut(v: Column, group: str, most: int, valid: Callable[[Column], Column]) -> Column:
    """``v`` as an array of pieces that join to it: from the left, the longest
    run of at most ``most`` groups that is valid, else a single group.  A group
    has the separator before it, if any.  Pieces gather in blocks of groups,
    which are joined at the end, so the time grows with the length of ``v``."""
    def pieces(p):
        run = lambda i, n: F.array_join(F.slice(p, i, n), "")

        def turn(s, i):
            fits = F.filter(F.sequence(F.least(F.lit(most), F.size(p) - i + 1), F.lit(1), F.lit(-1)),
                            lambda n: valid(run(i, n)))
            taken = F.transform(F.array(F.coalesce(F.get(fits, F.lit(0)), F.lit(1))), lambda n: F.struct(
                F.concat(s["out"], F.array(run(i, n))).alias("out"), (i + n).alias("next")))[0]
            return F.when(i < s["next"], s).otherwise(taken)

        def block(s, first):
            start = F.struct(F.array().cast("array<string>").alias("out"), s["next"].alias("next"))
            places = F.sequence(first, F.least(first + CUT_BLOCK - 1, F.size(p)))
            return F.transform(F.array(F.aggregate(places, start, turn)), lambda b: F.struct(
                F.concat(s["out"], F.array(b["out"])).alias("out"), b["next"].alias("next")))[0]

        start = F.struct(F.array().cast("array<array<string>>").alias("out"), F.lit(1).alias("next"))
        return F.aggregate(F.sequence(F.lit(1), F.size(p), F.lit(CUT_BLOCK)), start, block, lambda s: F.flatten(s["out"]))

    return F.transform(F.array(F.regexp_extract_all(v, F.lit(group), F.lit(0))), pieces)[0]


def _is_card(v: Column) -> Column:
    return F.transform(F.array(_only_digits(v)), lambda d: F.length(d).between(13, 19) & (_luhn(d) == 0))[0]


def cut_cards(v: Column) -> Column:
    """A run of digit groups that is not one card as a whole, cut at its blanks
    and hyphens.  Groups of one or two digits are no part of a cut card: in rows
    of small numbers some cut has a right Luhn digit nearly always."""
    small = F.lit(r"(?<![0-9])[0-9]{1,2}(?![0-9])")
    return F.when(_is_card(v) | ~v.rlike("[0-9]{3}"), F.array(v)).otherwise(
        _cut(v, r"[ -]?[0-9]+", 6, lambda w: ~F.regexp_like(w, small) & _is_card(w)))


def card(key: str, v: Column) -> Column:
    """13 to 19 digits with a right Luhn digit: the digits between the first
    one and the check digit are permuted, the check digit is set anew."""
    d = _only_digits(v)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)),
                    permute_digits(key, "card", F.substr(d, F.lit(2), F.length(d) - 2)))
    new = F.transform(F.array(body), lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))[0]
    return F.when(_is_card(v), _refill(v, new))


def phone(key: str, v: Column) -> Column:
    """Ten digits in the layout of a phone number, after an optional country
    code 1: the ten are permuted, code and layout stay."""
    d = _only_digits(v)
    n = F.length(d)
    new = F.concat(F.substr(d, F.lit(1), n - 10), permute_digits(key, "phone", F.substr(d, n - 9, F.lit(10))))
    return F.when(n.between(10, 11), _refill(v, new))


def ip(key: str, v: Column) -> Column:
    """An IPv4 address whose parts are 0 to 255: 2 x 16 bits are permuted."""
    part = lambda i: _int(F.split(v, r"\.")[i])
    got = permute_pair(key, "ip", part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536))
    new = F.transform(F.array(got), lambda p: F.concat_ws(
        ".", *[F.floor(x / 256).cast("string") if high else (x % 256).cast("string")
               for x in (p["l"], p["r"]) for high in (True, False)]))[0]
    return F.when((part(0) < 256) & (part(1) < 256) & (part(2) < 256) & (part(3) < 256), new)


def ssn(key: str, v: Column) -> Column:
    """A social security number: areas 001-665 and 667-899, groups 01-99,
    serials 0001-9999."""
    d = _only_digits(v)
    area, group, serial = (_int(F.substr(d, F.lit(a), F.lit(n))) for a, n in ((1, 3), (4, 2), (6, 4)))
    got = permute_pair(key, "ssn", area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1,
                       F.lit(898), F.lit(99 * 9999))
    new = F.transform(F.array(got), lambda p: F.concat_ws(
        "-", F.lpad((p["l"] + F.when(p["l"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
        F.lpad((F.floor(p["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["r"] % 9999 + 1).cast("string"), 4, "0")))[0]
    return F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), new)


def _date(key: str, v: Column, pattern: str, order: str) -> Column:
    """A real date from 1900 to 2099 in the given order of year, month, day."""
    group = {c: i + 1 for i, c in enumerate(order)}
    part = lambda c: F.regexp_extract(v, pattern, group[c])
    day = F.try_to_date(F.concat_ws("-", part("y"), F.lpad(part("m"), 2, "0"), F.lpad(part("d"), 2, "0")))
    n = F.datediff(day, F.lit("1900-01-01").cast("date"))
    got = permute_pair(key, "date", F.floor(n / DAY_B), n % DAY_B, F.lit(DAY_A), F.lit(DAY_B))
    mark = F.regexp_extract(v, r"[-/.]", 0)

    def write(p):
        new = F.date_add(F.lit("1900-01-01").cast("date"), (p["l"] * DAY_B + p["r"]).cast("int"))
        return F.concat_ws("", *[x for c in order for x in (
            F.date_format(new, {"y": "yyyy", "m": "MM", "d": "dd"}[c]), mark)][:-1])

    return F.when(n.between(0, DAY_A * DAY_B - 1), F.transform(F.array(got), write)[0])


def date_ymd(key: str, v: Column) -> Column:
    return _date(key, v, r"([0-9]{4})[-/.]([0-9]{2})[-/.]([0-9]{2})", "ymd")


def _date_mdy(key: str, v: Column, pattern: str) -> Column:
    """A real month-first date from 1900 to 2099 whose day is over 12, so that
    it is no day-first date, becomes another such date: days to 28 are permuted
    with month and year, the 29th to 31st keep their day."""
    part = lambda i: _int(F.regexp_extract(v, pattern, i))
    m, d, y = part(1), part(2), part(3)
    mark = F.regexp_extract(v, r"[-/.]", 0)
    long_months = F.array(*map(F.lit, (1, 3, 5, 7, 8, 10, 12)))

    def write(l: Column, r: Column, a: int, b: int, tag: str, back: Callable) -> Column:  # noqa: E741
        def text(p):
            return F.concat_ws("", *[x for n, size in zip(back(p["l"], p["r"]), (2, 2, 4)) for x in (
                F.lpad(n.cast("string"), size, "0"), mark)][:-1])
        return F.transform(F.array(permute_pair(key, tag, l, r, F.lit(a), F.lit(b))), text)[0]

    real = F.try_to_date(F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))).isNotNull()
    leap = F.floor((y - 1904) / 4)  # 1904 to 2096 have 49 leap years
    return (F.when(~real | ~y.between(1900, 2099) | (d <= 12), F.lit(None).cast("string"))
            .when(d <= 28, write((y - 1900) * 12 + m - 1, d - 13, 2400, 16, "mdy", lambda l, r: (  # noqa: E741
                l % 12 + 1, r + 13, 1900 + F.floor(l / 12))))
            .when(m == 2, write(F.floor(leap / 7), leap % 7, 7, 7, "mdy leap", lambda l, r: (  # noqa: E741
                m, d, 1904 + 4 * (l * 7 + r))))
            .when(d <= 30, write(y - 1900, F.when(m == 1, 0).otherwise(m - 2), 200, 11, "mdy 30", lambda l, r: (  # noqa: E741
                F.when(r == 0, 1).otherwise(r + 2), d, 1900 + l)))
            .otherwise(write(y - 1900, F.array_position(long_months, m.cast("int")) - 1, 200, 7, "mdy 31", lambda l, r: (  # noqa: E741
                F.get(long_months, r.cast("int")), d, 1900 + l))))


def date_dmy(key: str, v: Column) -> Column:
    """Day first; where that is no date, month first.  Each layout has dates of
    its own to go to, so different dates stay different."""
    pattern = r"([0-9]{2})[-/.]([0-9]{2})[-/.]([0-9]{4})"
    return F.coalesce(_date(key, v, pattern, "dmy"), _date_mdy(key, v, pattern))


def _is_iban(v: Column) -> Column:
    return F.transform(F.array(F.replace(v, F.lit(" "), F.lit(""))), lambda x: F.when(
        x.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"),
        _mod97(F.concat(F.substr(x, F.lit(5)), F.substr(x, F.lit(1), F.lit(4)))) == 1).otherwise(False))[0]


def cut_ibans(v: Column) -> Column:
    """Groups of capitals and digits cut at their blanks (34 characters at most)."""
    return _cut(v, r" ?[A-Z0-9]+", 31, _is_iban)


def iban(key: str, v: Column) -> Column:
    """An account number, with or without blanks between its groups, whose
    check digits are right modulo 97: what follows them is permuted, and they
    are set anew."""
    def write(x):
        land, own = F.substr(x, F.lit(1), F.lit(2)), F.substr(x, F.lit(5))
        return F.transform(F.array(permute_text(key, "iban", own)), lambda b: F.concat(land, F.lpad(
            (98 - _mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b))[0]

    new = F.transform(F.array(F.replace(v, F.lit(" "), F.lit(""))), write)[0]
    return F.when(_is_iban(v), F.transform(F.array(new), lambda n: _refill(v, n, UPPER + DIGITS))[0])


def email(key: str, v: Column) -> Column:
    """The name before the @ is permuted, the domain stays."""
    return F.concat(permute_text(key, "email", F.substring_index(v, "@", 1)), F.lit("@"), F.substring_index(v, "@", -1))


def access_key(key: str, v: Column) -> Column:
    """Four fixed letters and 16 letters or digits, which are permuted."""
    return F.concat(F.substr(v, F.lit(1), F.lit(4)), permute_text(key, "access", F.substr(v, F.lit(5))))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    change: Callable[[str, Column], Column]
    cut: Callable[[Column], Column] | None = None  # a candidate as pieces, each a candidate or other text


#: In this order; what one kind has replaced is text to the next.
KINDS = [
    Kind("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9][A-Za-z0-9.-]{0,253}\.[A-Za-z]{2,24}(?![A-Za-z0-9])", email),
    Kind("iban", r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11})[A-Z0-9]++(?![a-z])(?: [A-Z0-9]++(?![a-z]))*+", iban, cut_ibans),
    Kind("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", access_key),
    Kind("ip", r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])", ip),
    Kind("date", r"(?<![0-9./-])[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}(?![0-9]|[/-][0-9])", date_ymd),
    Kind("date", r"(?<![0-9./-])[0-9]{2}([-/.])[0-9]{2}\1[0-9]{4}(?![0-9]|[/-][0-9])", date_dmy),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ssn),
    Kind("phone", r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])", phone),
    Kind("card", r"(?<![0-9-])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?:[ -][0-9]++)*+", card, cut_cards),
]
#: Every candidate holds one of these; texts without any are not searched further.
HINT = r"@|[0-9]{3}|[0-9][ .-][0-9]|(?:AKIA|ASIA)[A-Z0-9]"


def _changed(kind: Kind, key: str) -> Callable[[Column], Column]:
    return lambda v: F.coalesce(kind.change(key, v), v)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", kinds: list[Kind] = KINDS) -> DataFrame:
    """``docs`` with personal data in the text column replaced, and a column
    ``n_replaced`` (one of that name is replaced): the values changed.

    Rows are changed one by one, so repeated rows give repeated results; null
    texts stay null, empty ones empty, an empty table empty; other columns and
    null ids pass unread.  ``key`` is the secret: the same key gives the same
    pseudonyms in every run.
    """
    keep = [c for c in docs.columns if c.lower() != "n_replaced"]
    text, hint = "__pii_text", "__pii_hint"
    out = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(text),
                      F.coalesce(F.col(f"`{text_col}`").rlike(HINT), F.lit(False)).alias(hint),
                      F.lit(0).cast("bigint").alias("n_replaced"))
    for kind in kinds:
        found = F.when(F.col(hint), F.regexp_extract_all(F.col(text), F.lit(kind.pattern), F.lit(0)))
        out = out.withColumn("__pii_found", found)
        parts = F.split(F.col(text), kind.pattern, -1)
        if kind.cut:
            out = out.withColumn("__pii_cut", F.when(F.size("__pii_found") > 0, F.transform("__pii_found", kind.cut)))
            # nothing stands between the pieces of a candidate
            parts = F.concat(F.slice(parts, 1, 1), F.flatten(F.zip_with(
                F.col("__pii_cut"), F.slice(parts, F.lit(2), F.size("__pii_cut")),
                lambda p, t: F.concat(F.array_repeat(F.lit(""), F.size(p) - 1), F.array(t)))))
            out = out.withColumn("__pii_found", F.flatten("__pii_cut"))
        some = F.size("__pii_found") > 0
        out = out.withColumn("__pii_new", F.when(some, F.transform("__pii_found", _changed(kind, key))))
        joined = F.array_join(F.zip_with(parts, F.concat("__pii_new", F.array(F.lit(""))),
                                         lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        changed = F.size(F.filter(F.zip_with("__pii_found", "__pii_new", lambda a, b: a != b), lambda x: x))
        out = out.withColumns({text: F.when(some, joined).otherwise(F.col(text)),
                               "n_replaced": F.col("n_replaced") + F.when(some, changed).otherwise(0)})
        out = out.drop("__pii_found", "__pii_cut", "__pii_new")
    return out.select(*[(F.col(text).alias(c) if c == text_col else F.col(f"`{c}`")) for c in keep],
                      F.col("n_replaced").cast("bigint").alias("n_replaced"))
