"""Format-preserving pseudonyms for numbers and dates, by Feistel networks.

Card numbers, account numbers (IBAN), social security numbers, phone numbers,
IPv4 addresses and calendar dates are found by pattern, validated, and mapped
by a keyed permutation of the values that share their format: the same value
gets the same pseudonym in every document, different values get different
ones, and the result has the format of the value (length, separators, country,
check digits, calendar).

The permutation of a domain of a * b values writes a value as l * b + r and
adds to l and r in turn a keyed hash of the other one, modulo a and b.  Values
x become P'(P(x) + 1), where P' is the inverse of P, so none maps to itself.

All of it is DataFrame expressions; rows without a match are not touched.

Validity: card numbers have 13 to 19 digits (in groups or not) and pass the
Luhn check, as their pseudonyms do.  IBANs have a right check number, which is
computed anew.  Social security numbers have an area other than 000, 666 and
9xx, a group other than 00 and a serial other than 0000.  Phone numbers have a
leading plus sign, or an area code in brackets, or three parted groups of 3, 3
and 4 digits; country code and separators stay, and the other digits are
permuted alike however they are parted.  Addresses have four numbers up to 255.
Dates (year-month-day, day.month.year, month/day/year, or day/month/year if the
day is over 12) exist and lie from 1900 to 2099; those of the last form are
permuted among themselves, so that their pseudonyms are read alike.

Mail addresses are no numbers or dates, but name a person just as these do:
each one is replaced by letters that are a keyed hash of it, at a host that
cannot exist.

Defined cases: a null text stays null, an empty one empty; texts of any length
are searched whole; equal rows give equal results, repeated or not; ids are not
looked at; an empty table gives no row; other columns are passed on untouched,
whatever their names, except the counts named below, which are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.plans.naming import col, fresh

ROUNDS = 6

# The patterns of each kind, and the span of years of dates.
MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![\d.\-/])(?:(?:19|20)\d\d-\d\d-\d\d|\d{1,2}\.\d{1,2}\.(?:19|20)\d\d|\d{1,2}/\d{1,2}/(?:19|20)\d\d)(?![\d]|[.\-/]\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d]|-\d)"
PHONE = r"(?:(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}|(?<![\w(])\(\d{3}\) ?\d{3}[ .\-]\d{4}|(?<![\w.\-])\d{3}[ .\-]\d{3}[ .\-]\d{4})(?!\d)"
ADDRESS = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
CARD = r"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?!\d|[.\-]\d)"
#: Country codes, of which none begins another.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
KINDS = {"mail": MAIL, "iban": IBAN, "date": DATE, "ssn": SSN, "phone": PHONE, "address": ADDRESS, "card": CARD}
#: 1900-01-01 to 2099-12-31 has 73,049 days, 319 times 229.
DAYS = (319, 229)
FIRST_DAY = "1900-01-01"


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def keyed(key: str, label: Column | str, number: Column, modulus: Column) -> Column:
    """A keyed hash of a number, from 0 to modulus - 1."""
    name = F.lit(label) if isinstance(label, str) else label
    digest = F.sha2(F.concat_ws("|", F.lit(key), name, number.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def permuted(key: str, label: Column, x: Column, a: Column, b: Column) -> Column:
    """The pseudonym of x, from 0 to a * b - 1 (below 2**62), within a domain."""

    def forward(s: Column, i: Column) -> Column:
        salt = F.concat_ws("|", label, i.cast("string"))
        even = F.struct(F.pmod(s["l"] + keyed(key, salt, s["r"], a), a).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), F.pmod(s["r"] + keyed(key, salt, s["l"], b), b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    def backward(s: Column, i: Column) -> Column:
        salt = F.concat_ws("|", label, i.cast("string"))
        even = F.struct(F.pmod(s["l"] - keyed(key, salt, s["r"], a), a).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), F.pmod(s["r"] - keyed(key, salt, s["l"], b), b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    def split(v: Column) -> Column:
        # The quotient is a whole number below 2**53, so its double is exact.
        r = F.pmod(v, b).cast("long")
        return F.struct(F.round((v - r) / b).cast("long").alias("l"), r.alias("r"))

    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    mapped = F.aggregate(rounds, split(x.cast("long")), forward, lambda s: s["l"] * b + s["r"])
    return F.aggregate(F.reverse(rounds), bound(F.pmod(mapped + 1, a * b), split), backward, lambda s: s["l"] * b + s["r"])


def power10(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**k).cast("long") for k in range(10)]), (n + 1).cast("int"))


def permuted_digits(key: str, label: Column | str, digits: Column) -> Column:
    """The pseudonym of a string of 1 to 18 digits, of the same length."""
    name = F.lit(label) if isinstance(label, str) else label

    def body(d: Column) -> Column:
        n = F.length(d)
        whole = permuted(key, F.concat_ws("|", name, n.cast("string")), d.cast("long"), power10(F.ceil(n / 2)), power10(F.floor(n / 2)))
        return F.lpad(whole.cast("string"), n, F.lit("0"))

    return bound(digits, body)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, r"\D+", "")


def refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits, in order, replaced by the given ones."""
    chars = F.split(shape, "")
    step = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.rlike(r"^\d$"), F.struct(F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
        lambda s: s["out"],
    )
    return step


def luhn_sum(digits: Column, offset: int) -> Column:
    """Sum of digits from the right, every second one doubled; offset 0: the last counts once."""
    backward = F.split(F.reverse(digits), "")
    return F.aggregate(
        F.transform(backward, lambda c, i: F.when((i + offset) % 2 == 1, 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))), F.lit(0), lambda s, x: s + x
    )


def card(key: str, s: Column) -> Column:
    """Pseudonym of a card number, or null if it is none."""

    def body(d: Column) -> Column:
        payload = permuted_digits(key, "card", F.substr(d, F.lit(1), F.length(d) - 1))
        with_check = bound(payload, lambda p: F.concat(p, ((10 - luhn_sum(p, 1) % 10) % 10).cast("string")))
        return F.when(luhn_sum(d, 0) % 10 == 0, with_check)

    return bound(digits_of(s), lambda d: refilled(s, body(d)))


def iban_rest(s: Column) -> Column:
    """The number an IBAN (country, check number, account) stands for, modulo 97."""
    moved = F.split(F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4))), "")
    return F.aggregate(moved, F.lit(0), lambda r, c: F.when(c.rlike(r"^\d$"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))


def iban(key: str, s: Column) -> Column:
    """Pseudonym of an account number: other digits, a new check number."""

    def body(t: Column) -> Column:
        own = digits_of(F.substr(t, F.lit(5)))
        # Long runs of digits are permuted in two halves, each keyed by the whole of the other's old value.
        n = F.length(own)
        cut = F.when(n > 18, F.floor(n / 2)).otherwise(n).cast("int")
        country = F.substr(t, F.lit(1), F.lit(2))
        head = permuted_digits(key, F.concat_ws("|", F.lit("iban"), country), F.substr(own, F.lit(1), cut))
        tail = F.when(n > cut, permuted_digits(key, F.concat_ws("|", F.lit("iban"), country, F.substr(own, F.lit(1), cut)), F.substr(own, cut + 1, n - cut))).otherwise("")
        account = refilled(F.substr(t, F.lit(5)), F.concat(head, tail))
        check = bound(account, lambda x: F.lpad((98 - iban_rest(F.concat(country, F.lit("00"), x))).cast("string"), 2, "0"))
        new = F.concat(check, digits_of(account))
        return F.when((iban_rest(t) == 1) & (n > 0), new)

    return bound(F.replace(s, F.lit(" "), F.lit("")), lambda t: F.concat(F.substr(s, F.lit(1), F.lit(2)), refilled(F.substr(s, F.lit(3)), body(t))))


def ssn(key: str, s: Column) -> Column:
    """Pseudonym among the valid numbers: areas 001-665 and 667-899, groups 01-99, serials 0001-9999."""
    area, group, serial = (F.substr(s, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    ok = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    rank = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    new = permuted(key, F.lit("ssn"), rank, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"))

    def text(v: Column) -> Column:
        left = F.floor(v / 9999)
        a = F.floor(left / 99)
        return F.concat_ws("-", F.lpad((a + F.when(a > 664, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((left % 99 + 1).cast("string"), 2, "0"), F.lpad((v % 9999 + 1).cast("string"), 4, "0"))

    return F.when(ok, bound(new, text))


def phone(key: str, s: Column) -> Column:
    """Other digits after the country code; none for too few or too many of them."""
    code = F.regexp_extract(s, COUNTRY, 0)
    rest = F.substr(s, F.length(code) + 1)
    own = digits_of(rest)
    return F.when(F.length(own).between(7, 14), F.concat(code, bound(rest, lambda r: refilled(r, permuted_digits(key, "phone", digits_of(r))))))


def address(key: str, s: Column) -> Column:
    """Another IPv4 address."""

    def body(p: Column) -> Column:
        n = [p[i].cast("long") for i in range(4)]
        new = permuted(key, F.lit("address"), ((n[0] * 256 + n[1]) * 256 + n[2]) * 256 + n[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"))
        text = bound(new, lambda v: F.concat_ws(".", *[F.pmod(F.shiftright(v, k), F.lit(256)).cast("string") for k in (24, 16, 8, 0)]))
        return F.when(reduce(lambda a, b: a & b, [x < 256 for x in n]), text)

    return bound(F.split(s, r"\."), body)


def date(key: str, s: Column) -> Column:
    """Another day of 1900 to 2099, written alike."""

    def shown(d: Column, order: tuple[str, str, str], sep: str) -> Column:
        part = {"y": F.date_format(d, "yyyy"), "m": F.date_format(d, "MM"), "d": F.date_format(d, "dd")}
        return F.concat_ws(sep, *[part[x] for x in order])

    first = F.to_date(F.lit(FIRST_DAY))

    def one(order: tuple[str, str, str], sep: str) -> Column:
        p = F.split(s, r"\." if sep == "." else sep)
        at = {x: p[i] for i, x in enumerate(order)}
        day = F.try_to_date(F.concat_ws("-", at["y"], F.lpad(at["m"], 2, "0"), F.lpad(at["d"], 2, "0")), "yyyy-MM-dd")
        new = F.date_add(first, permuted(key, F.lit("date"), F.datediff(day, first), *[F.lit(x).cast("long") for x in DAYS]).cast("int"))
        return F.when(day.isNotNull(), bound(new, lambda d: shown(d, order, sep)))

    def late() -> Column:
        """Day/month/year with a day over 12: a month since 1900, and one of 19 days; skips days that are none."""
        p = F.split(s, "/")
        day = F.try_to_date(F.concat_ws("-", p[2], F.lpad(p[1], 2, "0"), F.lpad(p[0], 2, "0")), "yyyy-MM-dd")
        number = ((F.year(day) - 1900) * 12 + F.month(day) - 1) * 19 + F.dayofmonth(day) - 13

        def of(v: Column) -> Column:
            month = F.floor(v / 19).cast("int")
            return F.date_add(F.add_months(first, month), (v % 19 + 12).cast("int"))

        def exists(v: Column) -> Column:
            return F.dayofmonth(of(v)) == v % 19 + 13

        def again(v: Column) -> Column:
            return permuted(key, F.lit("late"), v, F.lit(2400).cast("long"), F.lit(19).cast("long"))

        # 3 of 100 numbers are no days; 40 steps miss one day in 10 ** 60.
        new = F.aggregate(F.sequence(F.lit(1), F.lit(40)), again(number.cast("long")), lambda v, _: F.when(exists(v), v).otherwise(again(v)))
        return F.when(day.isNotNull() & (F.dayofmonth(day) > 12), bound(new, lambda v: shown(of(v), ("d", "m", "y"), "/")))

    slashed = F.coalesce(one(("m", "d", "y"), "/"), late())
    return F.when(s.contains("-"), one(("y", "m", "d"), "-")).when(s.contains("/"), slashed).otherwise(one(("d", "m", "y"), "."))


def mail(key: str, s: Column) -> Column:
    """A keyed name before a keyed host that no one has."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(s)), 256)
    return F.concat(F.translate(F.substring(digest, 1, 16), "0123456789", "ghijklmnop"), F.lit("@example.invalid"))


_MAKERS = {"mail": mail, "iban": iban, "date": date, "ssn": ssn, "phone": phone, "address": address, "card": card}


def kind_of(s: Column, kinds: tuple[str, ...]) -> Column:
    """The first kind whose pattern a value has."""
    return F.coalesce(*[F.when(s.rlike(f"^(?:{KINDS[k]})$"), F.lit(k)) for k in kinds])


def replaced(key: str, text: Column, kinds: tuple[str, ...]) -> Column:
    """Struct of the new text and the kinds of the values replaced in it."""
    pattern = "|".join(f"(?:{KINDS[k]})" for k in kinds)

    def made(s: Column) -> Column:
        def by_kind(kind: Column) -> Column:
            new = reduce(lambda c, k: c.when(kind == k, _MAKERS[k](key, s)), kinds[1:], F.when(kind == kinds[0], _MAKERS[kinds[0]](key, s)))
            return bound(new, lambda n: F.struct(F.coalesce(n, s).alias("new"), F.when(n.isNotNull(), kind).alias("kind")))

        return bound(kind_of(s, kinds), by_kind)

    def joined(got: Column) -> Column:
        # Parts and values by turns; there is one part more than values.
        whole = F.array_join(F.zip_with(F.split(text, pattern, -1), got, lambda p, m: F.concat(p, F.coalesce(m["new"], F.lit("")))), "")
        return F.struct(whole.alias("text"), F.filter(F.transform(got, lambda m: m["kind"]), lambda k: k.isNotNull()).alias("kinds"))

    return bound(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), made), joined)


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """``docs`` with pseudonyms in the text column, and ``n_<kind>`` counts.

    A match belongs to the first of ``kinds`` that fits.  A narrow projection:
    no shuffle; texts without a digit and an at sign are not searched.  Columns
    named ``n_<kind>`` are replaced.
    """
    text = col(text_col).cast("string")
    counts = [f"n_{k}" for k in kinds]
    (made,) = fresh([*docs.columns, *counts], "made")
    names = [c for c in docs.columns if c not in counts]
    rows = docs.select(*[text.alias(c) if c == text_col else col(c) for c in names], F.when(text.rlike("[@0-9]"), replaced(key, text, kinds)).alias(made))

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter(col(made)["kinds"], lambda x: x == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")

    return rows.select(*[F.coalesce(col(made)["text"], col(c)).alias(c) if c == text_col else col(c) for c in names], *[count(k) for k in kinds])
