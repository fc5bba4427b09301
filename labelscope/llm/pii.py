"""Personal data replaced by format-preserving pseudonyms, with DataFrame functions only.

Found and, where the kind has a check, validated: card numbers (Luhn), IBANs (mod 97), US
social security numbers (ranges), phone numbers, IPv4 addresses (octets), dates (calendar,
1900-2099), e-mail addresses, and secrets assigned to a name. A candidate that fails its
check stays as it is, and the search goes on at the next place inside it. An IBAN ends where
its country's length is reached, a phone number at 15 digits at most or before a date.

Numbers and dates are permuted by a keyed Feistel network over exactly the values of
their format: digits over 10^a x 10^b, an address over 2^16 x 2^16, a date over the 73,049
days of two centuries (17 x 4,297), a social security number over its valid ranges. So the
pseudonym is valid, keeps separators, and equal values get equal pseudonyms in every
document while different values stay different. E-mail addresses and secrets, which are
neither, get a keyed hash in their own shape. A secret is the whole run of value characters
behind its name, however long, with single dots and signs between its parts; its first
``LEAST_SECRET`` characters hold letters, digits, ``+/_-`` and dots only. Shorter ones stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8  # even, so that both halves end where they began
_DAYS = (17, 4297)
_FIRST_DAY = "1900-01-01"

LEAST_SECRET = 12
_SECRET_NAME = (
    r"(?:(?<![A-Za-z0-9])(?i:token|secret|api[_-]?key|passw(?:or)?d)"
    r"|(?<=[a-z0-9])(?:Token|Secret|Api[_-]?[Kk]ey|API[_-]?[Kk]ey|Passw(?:or)?d))"
)
_SECRET_LINK = r"""["']?[ \t]{0,3}[=:][ \t]{0,3}["']?"""
_PART = r"[A-Za-z0-9+/_\-]"
_SECRET = rf"(?={_PART}(?:\.?{_PART}){{{LEAST_SECRET - 1}}}){_PART}++(?:[.~!@$%^*:]{_PART}++)*+={{0,2}}+"

# Characters of an IBAN by country.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """As long as the country's IBANs are; any length where the country is not listed or the length is another."""
    listed = "|".join(
        f"(?:{countries.replace(' ', '|')})\\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])"
        for n, countries in _IBAN_LENGTHS.items()
    )
    return f"(?:{listed}|[A-Z]{{2}}\\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))"


# A group of a phone number is no date behind a blank, and a number has 15 digits at most.
_NO_DATE = r"(?! (?:(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[./](?:0?[1-9]|[12]\d|3[01])[./](?:19|20)\d\d)(?!\d))"
_TO_15 = r"(?<!\d" + r"[ .\-()]{0,2}\d" * 15 + ")"

# What candidates look like, tried in this order at each place.
KINDS = {
    "secret": _SECRET_NAME + _SECRET_LINK + _SECRET,
    "email": r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}",
    "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)",
    "date": r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?!\d|[./\-]\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?!\d|-\d)",
    "iban": _iban_pattern(),
    "card": r"(?:\d{13,19}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)",
    "phone": (
        r"(?:(?:\+?1[ .\-]?)?\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}|\+1[ .\-]?\d{3}[ .\-]?\d{3}[ .\-]?\d{4}"
        r"|\d{3}[.\-]\d{3}[.\-]\d{4}|\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})"
        rf"(?:{_NO_DATE}[ .\-]?\d{{2,4}}){{1,4}}{_TO_15})(?!\d)"
    ),
}
_START = {"secret": "", "email": r"(?<![A-Za-z0-9._%+\-])", "ip": r"(?<![A-Za-z0-9])(?<!\d\.)", "phone": r"(?<![A-Za-z0-9+(])"}
CANDIDATE = "|".join(f"{_START.get(k, r'(?<![A-Za-z0-9])')}(?:{p})" for k, p in KINDS.items())
_WORTH_A_LOOK = r"@|\d[\d ().\-/]{5}|(?i:token|secret|key|passw)"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _round(key: str, tag: str, i: Column, half: Column) -> Column:
    """A keyed number of 60 bits."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), half.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def feistel(left: Column, right: Column, n_left: Column, n_right: Column, key: str, tag: str) -> Column:
    """Struct (a, b): a keyed permutation of the pairs below (``n_left``, ``n_right``)."""
    big = lambda c: c.cast("bigint")

    def step(state: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, big(n_left)).otherwise(big(n_right))
        moved = (state["a"] + _round(key, tag, i, state["b"]) % size) % size
        return F.struct(state["b"].alias("a"), moved.alias("b"))

    rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return F.aggregate(rounds, F.struct(big(left).alias("a"), big(right).alias("b")), step)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n.cast("int") + 1, "0").cast("bigint")


def permuted_digits(digits: Column, key: str, tag: str) -> Column:
    """A string of up to 34 digits permuted among those of its length; one digit is shifted."""

    def body(d: Column) -> Column:
        n = F.length(d)
        a = F.ceil(n / F.lit(2)).cast("int")
        b = n - a
        left = F.substr(d, F.lit(1), a).cast("bigint")
        right = F.coalesce(F.substr(d, a + 1).try_cast("bigint"), F.lit(0).cast("bigint"))
        mixed = feistel(left, right, _power(a), _power(b), key, tag)
        return _let(mixed, lambda m: F.concat(
            F.lpad(m["a"].cast("string"), a, "0"),
            F.when(b > 0, F.lpad(m["b"].cast("string"), b, "0")).otherwise(""),
        ))

    return F.when(F.length(digits) == 0, digits).otherwise(_let(digits, body))


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order; whatever separates them stays."""
    seen = lambda i: F.length(F.regexp_replace(F.substr(shape, F.lit(1), i), r"\D", ""))
    at = lambda i: F.substr(shape, i, F.lit(1))
    return F.array_join(F.transform(
        F.sequence(F.lit(1), F.length(shape)),
        lambda i: F.when(at(i).rlike(r"\d"), F.substr(digits, seen(i), F.lit(1))).otherwise(at(i)),
    ), "")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


# --- kinds -----------------------------------------------------------------------------
# Each: (condition that a match of the kind's pattern is one, pseudonym).


def _card(m: Column, key: str) -> Column:
    """First digit kept (the issuer's kind), check digit worked out anew."""
    body = lambda d: F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted_digits(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
    checked = lambda p: F.concat(p, F.filter(F.array(*[F.lit(str(c)) for c in range(10)]), lambda c: F.call_function("luhn_check", F.concat(p, c)))[0])
    return _let(_let(_let(_digits(m), body), checked), lambda d: _refilled(m, d))


def _is_ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)


def _ip(m: Column, key: str) -> Column:
    def body(o: Column) -> Column:
        n = lambda i: o[i].cast("bigint")
        side = F.lit(65536)
        return _let(feistel(n(0) * 256 + n(1), n(2) * 256 + n(3), side, side, key, "ip"), lambda r: F.concat_ws(
            ".", *[F.floor(r[h] / F.lit(256)).cast("string") if i == 0 else (r[h] % 256).cast("string") for h in ("a", "b") for i in (0, 1)]
        ))

    return _let(F.split(m, r"\."), body)


def _numbers(m: Column) -> Column:
    return F.split(m, r"[./\-]")


def _made(year: Column, month: Column, day: Column) -> Column:
    """A date, or null if there is no such day."""
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def _day(m: Column) -> Column:
    """The day a date names, day before month if both can be; null if there is none such."""
    def body(p: Column) -> Column:
        iso = _made(p[0], p[1], p[2])
        return F.when(m.rlike(r"^\d{4}-"), iso).otherwise(F.coalesce(_made(p[2], p[1], p[0]), _made(p[2], p[0], p[1])))

    found = _let(_numbers(m), body)
    return F.when(F.year(found).between(1900, 2099), found)


def _date(m: Column, key: str) -> Column:
    def written(d: Column) -> Column:
        sep = F.regexp_extract(m, r"[./\-]", 0)
        day, month, year = F.date_format(d, "dd"), F.date_format(d, "MM"), F.date_format(d, "yyyy")
        numbers = _numbers(m)
        month_first = _made(numbers[2], numbers[1], numbers[0]).isNull()
        return (
            F.when(m.rlike(r"^\d{4}-"), F.concat_ws("-", year, month, day))
            .when(month_first, F.concat(month, sep, day, sep, year)).otherwise(F.concat(day, sep, month, sep, year))
        )

    n = F.datediff(_day(m), F.lit(_FIRST_DAY).cast("date"))
    mixed = feistel(F.floor(n / F.lit(_DAYS[1])), n % _DAYS[1], F.lit(_DAYS[0]), F.lit(_DAYS[1]), key, "date")
    return _let(_let(mixed, lambda r: F.date_add(F.lit(_FIRST_DAY).cast("date"), (r["a"] * _DAYS[1] + r["b"]).cast("int"))), written)


def _is_ssn(m: Column) -> Column:
    return ~m.rlike(r"^(000|666|9\d\d)|^\d{3}-00|0000$")


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999."""
    def body(p: Column) -> Column:
        area = p[0] - F.when(p[0] > 666, 2).otherwise(1)
        return _let(feistel(area * 99 + p[1] - 1, p[2] - 1, F.lit(898 * 99), F.lit(9999), key, "ssn"), written)

    def written(r: Column) -> Column:
        area = F.floor(r["a"] / F.lit(99))
        area = area + F.when(area >= 665, 2).otherwise(1)
        pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
        return F.concat_ws("-", pad(area, 3), pad(r["a"] % 99 + 1, 2), pad(r["b"] + 1, 4))

    return _let(F.transform(F.split(m, "-"), lambda x: x.cast("bigint")), body)


def _mod97(text: Column) -> Column:
    """Remainder of the number an IBAN's letters and digits spell."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda r, c: F.when(c == "", r).when(
        c.rlike(r"\d"), (r * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))


def _is_iban(m: Column) -> Column:
    return _let(F.replace(m, F.lit(" "), F.lit("")), lambda c: _mod97(F.concat(F.substr(c, F.lit(5)), F.substr(c, F.lit(1), F.lit(4)))) == 1)


def _iban(m: Column, key: str) -> Column:
    """Country and letters kept, account digits permuted, check digits worked out anew."""
    def body(c: Column) -> Column:
        account, country = F.substr(c, F.lit(5)), F.substr(c, F.lit(1), F.lit(2))
        mixed = _refilled(account, permuted_digits(_digits(account), key, "iban"))
        return _let(mixed, lambda a: F.concat(
            F.lpad((F.lit(98) - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), _digits(a)))

    return _let(_let(F.replace(m, F.lit(" "), F.lit("")), body), lambda d: _refilled(m, d))


def _phone(m: Column, key: str) -> Column:
    """A country code in front of a + stays; the other digits are permuted."""
    lead = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .\-(])", 0)
    rest = F.substr(m, F.length(lead) + 1)
    return F.concat(lead, _let(permuted_digits(_digits(rest), key, "phone"), lambda d: _refilled(rest, d)))


def _keyed(value: Column, key: str, tag: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), value).cast("binary"), 256)


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(
        F.substring(_keyed(F.lower(m), key, "email"), 1, 12), F.lit("@"),
        F.substring(_keyed(F.lower(F.substr(m, at + 1)), key, "domain"), 1, 8), F.lit(".invalid"),
    )


def _secret(m: Column, key: str) -> Column:
    """The name stays, the value becomes hex digits of its length."""
    value = F.regexp_extract(m, f"^[^=:]*?{_SECRET_LINK}(.*)$", 1)
    n = F.length(value)
    return F.concat(F.substr(m, F.lit(1), F.length(m) - n), F.substr(F.repeat(_keyed(value, key, "secret"), F.ceil(n / F.lit(64)).cast("int")), F.lit(1), n))


def _whole(kind: str) -> str:
    return f"^(?:{KINDS[kind]})$"


def pseudonym(m: Column, key: str) -> Column:
    """Struct (kind, value, length) of a candidate; kind is null, and the value as it was, if no check holds."""
    rules = [
        ("secret", m.rlike(f"(?i)^(?:token|secret|api[_-]?key|passw(?:or)?d){_SECRET_LINK}{_SECRET}$"), _secret), ("email", m.rlike(_whole("email")), _email),
        ("ip", m.rlike(_whole("ip")) & _is_ip(m), _ip),
        ("date", m.rlike(_whole("date")) & _day(m).isNotNull(), _date),
        ("ssn", m.rlike(_whole("ssn")) & _is_ssn(m), _ssn),
        ("iban", m.rlike(_whole("iban")) & _is_iban(m), _iban),
        ("card", m.rlike(_whole("card")) & F.call_function("luhn_check", _digits(m)), _card),
        ("phone", m.rlike(_whole("phone")) & F.length(_digits(m)).between(9, 15), _phone),
    ]
    kinds = F.lit(None).cast("string")
    for name, holds, _ in reversed(rules):
        kinds = F.when(holds, F.lit(name)).otherwise(kinds)

    def value(kind: Column) -> Column:
        out = m
        for name, _, make in reversed(rules):
            out = F.when(kind == name, make(m, key)).otherwise(out)
        return F.struct(kind.alias("kind"), out.alias("value"), F.length(m).alias("length"))

    return _let(kinds, value)


def _replaced(pieces: Column, parts: Column) -> Column:
    """Struct (text, found): ``pieces`` start where candidates do, but the first, which is led by a line feed.

    A candidate is taken if its check holds and no one taken before it reaches over its start.
    """
    def step(s: Column, x: Column) -> Column:
        taken = (s["over"] == 0) & x["kind"].isNotNull()
        over = F.when(taken, x["length"]).otherwise(s["over"])
        here = F.least(over, F.length(x["piece"]))
        new = F.concat(F.when(taken, x["value"]).otherwise(""), F.substr(x["piece"], here + 1))
        return F.struct(
            F.concat(s["out"], F.array(new)).alias("out"), (over - here).alias("over"),
            F.when(taken, F.concat(s["found"], F.array(x["kind"]))).otherwise(s["found"]).alias("found"),
        )

    rows = F.zip_with(F.slice(pieces, 2, F.size(parts)), parts, lambda piece, x: F.struct(
        piece.alias("piece"), x["kind"].alias("kind"), x["value"].alias("value"), x["length"].alias("length")))
    none = F.array().cast("array<string>")
    start = F.struct(F.array(F.substr(pieces[0], F.lit(2))).alias("out"), F.lit(0).alias("over"), none.alias("found"))
    return F.aggregate(rows, start, step, lambda s: F.struct(F.array_join(s["out"], "").alias("text"), s["found"].alias("found")))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", into: str = "text", found: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; all other columns kept.

    ``into`` names the column that gets the new text (replacing one of that name), ``found``
    an optional array of the kinds replaced, in text order. A null text stays null, an
    empty one empty, and nothing is found in either; texts of any length are read whole.
    Row by row, so repeated rows give equal rows, and an empty table an empty one. A column
    called ``into`` or ``found`` is overwritten; no other name is used.
    """
    text = F.col(text_col).cast("string")
    # A line feed in front, so that a candidate at the start has a piece before it like any other.
    led = F.concat(F.lit("\n"), text)
    made = F.transform(F.regexp_extract_all(led, F.lit(f"(?=({CANDIDATE}))"), F.lit(1)), lambda m: pseudonym(m, key))
    none = F.array().cast("array<struct<kind:string,value:string,length:int>>")
    parts = F.when(text.rlike(_WORTH_A_LOOK), made).otherwise(none)
    new = _let(parts, lambda p: F.when(F.exists(p, lambda x: x["kind"].isNotNull()), _let(
        F.split(led, f"(?={CANDIDATE})", -1), lambda pieces: _replaced(pieces, p))).otherwise(
        F.struct(text.alias("text"), F.array().cast("array<string>").alias("found"))))
    out = {into: F.when(text.isNotNull(), new["text"])}
    if found:
        out[found] = F.when(text.isNotNull(), new["found"]).otherwise(F.array().cast("array<string>"))
    if not found:
        return docs.withColumn(into, out[into])
    # One struct for both columns, under a name no other column can have.
    name = "_pii" + "_" * max(len(c) for c in docs.columns)
    return docs.withColumn(name, new).withColumns({
        into: F.col(name)["text"], found: F.coalesce(F.col(name)["found"], F.array().cast("array<string>")),
    }).drop(name)
