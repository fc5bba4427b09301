"""The whole query against a plain Python version: its own Feistel network, checks and search."""

import hashlib
from datetime import date, timedelta

import regex

from labelscope.llm import pii
from labelscope.llm.queries import PII_KEY, queries

FIRST = date(1900, 1, 1)


def keyed_number(tag, i, half):
    return int(hashlib.sha256(f"{PII_KEY}|{tag}|{i}|{half}".encode()).hexdigest()[:15], 16)


def feistel(left, right, n_left, n_right, tag):
    for i in range(8):
        size = n_left if i % 2 == 0 else n_right
        left, right = right, (left + keyed_number(tag, i, right) % size) % size
    return left, right


def permuted(digits, tag):
    if not digits:
        return digits
    a = -(-len(digits) // 2)
    b = len(digits) - a
    left, right = feistel(int(digits[:a]), int(digits[a:] or 0), 10 ** a, 10 ** b, tag)
    return str(left).zfill(a) + (str(right).zfill(b) if b else "")


def refilled(shape, digits):
    left = iter(digits)
    return "".join(next(left) if "0" <= c <= "9" else c for c in shape)


def only_digits(m):
    return regex.sub(r"[^0-9]", "", m)


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text) or 0) % 97


def day_of(m):
    p = regex.split(r"[./-]", m)
    orders = [(p[0], p[1], p[2])] if regex.match(r"[0-9]{4}-", m) else [(p[2], p[1], p[0]), (p[2], p[0], p[1])]
    for k, (y, mo, d) in enumerate(orders):
        try:
            found = date(int(y), int(mo), int(d))
        except ValueError:
            continue
        return (found, k) if 1900 <= found.year <= 2099 else None
    return None


def make_date(m):
    day, swapped = day_of(m)
    n = (day - FIRST).days
    a, b = feistel(n // 4297, n % 4297, 17, 4297, "date")
    new, sep = FIRST + timedelta(a * 4297 + b), regex.search(r"[./-]", m).group()
    if regex.match(r"[0-9]{4}-", m):
        return new.isoformat()
    return new.strftime(f"%m{sep}%d{sep}%Y" if swapped else f"%d{sep}%m{sep}%Y")


def make_ssn(m):
    area, group, serial = map(int, m.split("-"))
    a, b = feistel((area - (2 if area > 666 else 1)) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
    area = a // 99
    return f"{area + (2 if area >= 665 else 1):03d}-{a % 99 + 1:02d}-{b + 1:04d}"


def make_ip(m):
    o = list(map(int, m.split(".")))
    a, b = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def make_iban(m):
    c = m.replace(" ", "")
    account = refilled(c[4:], permuted(only_digits(c[4:]), "iban"))
    return refilled(m, f"{98 - mod97(account + c[:2] + '00'):02d}" + only_digits(account))


def make_card(m):
    d = only_digits(m)
    body = d[0] + permuted(d[1:-1], "card")
    return refilled(m, body + next(c for c in "0123456789" if luhn(body + c)))


def make_phone(m):
    lead = regex.match(r"(?:\+[0-9]{1,3}(?=[ .\-(]))?", m).group()
    return lead + refilled(m[len(lead):], permuted(only_digits(m[len(lead):]), "phone"))


def keyed(value, tag):
    return hashlib.sha256(f"{PII_KEY}|{tag}|{value}".encode()).hexdigest()


def make_email(m):
    return f"{keyed(m.lower(), 'email')[:12]}@{keyed(m.split('@', 1)[1].lower(), 'domain')[:8]}.invalid"


def make_secret(m):
    head = regex.match(rf"[^=:]*?{pii._SECRET_LINK}", m).group()
    value = m[len(head):]
    return head + (keyed(value, "secret") * (len(value) // 64 + 1))[: len(value)]


def whole(kind, m):
    return regex.fullmatch(f"(?:{pii.KINDS[kind]})", m, flags=regex.ASCII) is not None


def pseudonym(m):
    """(kind, new value) of a candidate, or None."""
    digits = only_digits(m)
    tests = [
        ("secret", regex.fullmatch(rf"(?i:(?:token|secret|api[_-]?key|passw(?:or)?d){pii._SECRET_LINK}{pii._SECRET})", m), make_secret),
        ("email", whole("email", m), make_email),
        ("ip", whole("ip", m) and all(int(o) < 256 for o in m.split(".")), make_ip),
        ("date", whole("date", m) and day_of(m), make_date),
        ("ssn", whole("ssn", m) and not regex.match(r"000|666|9|...-00|.*0000$", m), make_ssn),
        ("iban", whole("iban", m) and mod97((m.replace(" ", ""))[4:] + m.replace(" ", "")[:4]) == 1, make_iban),
        ("card", whole("card", m) and luhn(digits), make_card),
        ("phone", whole("phone", m) and 9 <= len(digits) <= 15, make_phone),
    ]
    return next(((kind, make(m)) for kind, holds, make in tests if holds), None)


CANDIDATE = regex.compile(pii.CANDIDATE, regex.ASCII)


def replaced(text):
    out, found, at, done = [], [], 0, 0
    while (m := CANDIDATE.search(text, at)) is not None:
        new = pseudonym(m.group())
        if new is None:
            at = m.start() + 1
            continue
        out += [text[done:m.start()], new[1]]
        found.append(new[0])
        at = done = m.end()
    return "".join([*out, text[done:]]), found


def test_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries()["op3_pii"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    kinds = set()
    for r in rows:
        want, found = replaced(texts[r.doc_id] or "")
        assert (r.text, list(r.found), r.n_found) == (want, found, len(found))
        kinds.update(found)
    assert len(kinds) >= 4
