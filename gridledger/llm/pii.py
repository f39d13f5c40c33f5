"""Format-preserving pseudonyms for personal data, in DataFrame expressions only.

Card numbers, social-security numbers, phone numbers, IPv4 addresses, e-mail names and calendar
dates are found by patterns and validated (Luhn digit, area and group rules, octets, real days).
Each valid value goes through a keyed Feistel network over exactly the values of its format, so the
result has the same shape and is again valid, two values never collide, and equal values get equal
pseudonyms in all documents. What does not validate is left as it is.

A text is split at the matches, the matches are replaced, and both are joined again; first e-mail
addresses where there is an `@`, then numbers where there are digits. Texts stay in their rows: nothing is shuffled.

Defined results: null texts stay null and empty texts empty, both with count 0; repeated rows are
masked each; whole texts are read, however long; all additional columns are kept by `mask` under
their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8  # even, so that both halves end in their places
FIRST_DAY, DAYS = "1901-01-01", 72684  # up to 2099-12-31; 108 * 673 days
DAY_PARTS = (108, 673)
SSN_AREAS, SSN_REST = 898, 99 * 9999  # areas 001-899 without 666; groups 01-99; serials 0001-9999

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]*[A-Za-z0-9])+"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])"
PHONE = (
    r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])"
    r"|(?<![0-9.-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?!-?[0-9])"
)
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,4}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"
# Numbers and dates begin with a digit, a plus or a bracket: all other places fail at once.
NUMBER = f"(?=[0-9+(])(?:{'|'.join((IPV4, DATE, SSN, PHONE, CARD))})"


def _keyed(key: str, tweak: Column, step: Column, value: Column, size: Column) -> Column:
    """Round function: a number below `size` from the key, the format, the round and one half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, step.cast("string"), value.cast("string")), 256)
    # 15 hexadecimal digits: below 2 ** 60.
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), size)


def feistel(key: str, tweak: Column, left: Column, right: Column, n_left: Column, n_right: Column) -> Column:
    """Keyed permutation of the pairs (left < n_left, right < n_right) as struct(a, b)."""
    begin = F.struct(
        left.cast("bigint").alias("a"), right.cast("bigint").alias("b"),
        n_left.cast("bigint").alias("m"), n_right.cast("bigint").alias("n"),
    )
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        begin,
        lambda s, i: F.struct(
            s["b"].alias("a"),
            # Both terms are below 2 ** 62, so the sum fits.
            F.pmod(s["a"] + _keyed(key, tweak, i, s["b"], s["m"]), s["m"]).alias("b"),
            s["n"].alias("m"),
            s["m"].alias("n"),
        ),
    )


def _power(radix: int, n: Column) -> Column:
    return F.pow(F.lit(radix).cast("decimal(2,0)").cast("double"), n).cast("bigint")


def _in_chunks(text: Column, size: int, change: Callable[[Column], Column]) -> Column:
    """Longer strings change chunk by chunk, so that all sizes stay within 64 bits."""
    return F.array_join(
        F.transform(F.regexp_extract_all(text, F.lit(f".{{1,{size}}}"), F.lit(0)), change), ""
    )


def _permute(key: str, tweak: str, text: Column, radix: int, read: Callable, write: Callable) -> Column:
    """Permutation of the strings of each length over an alphabet; halves become numbers."""
    n = F.length(text)
    cut = F.floor(n / 2).cast("int")
    left = F.when(cut > 0, read(F.substr(text, F.lit(1), cut))).otherwise("0")
    mixed = feistel(
        key, F.concat(F.lit(tweak), n.cast("string")), left, read(F.substr(text, cut + 1)),
        _power(radix, cut), _power(radix, n - cut),
    )
    return F.concat(write(mixed["a"], cut), write(mixed["b"], n - cut))


def _permute_digits(key: str, tweak: str, digits: Column) -> Column:
    return _in_chunks(
        digits,
        30,
        lambda c: _permute(
            key, tweak, c, 10, lambda t: t, lambda v, n: F.lpad(v.cast("string"), n, "0")
        ),
    )


LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASE26 = "0123456789abcdefghijklmnop"


def _permute_letters(key: str, tweak: str, letters: Column) -> Column:
    def word(value: Column, size: Column) -> Column:
        text = F.lower(F.conv(value.cast("string"), 10, 26))
        return F.translate(F.lpad(text, size, "0"), BASE26, LETTERS)

    return _in_chunks(
        letters,
        24,
        lambda c: _permute(
            key, tweak, c, 26, lambda t: F.conv(F.translate(t, LETTERS, BASE26), 26, 10), word
        ),
    )


def _refill(value: Column, of: str, fresh: Column) -> Column:
    """`value` with its characters of a class replaced, in order, by those of `fresh`."""
    letter = lambda i: F.substr(value, i, F.lit(1))
    seen = lambda i: F.length(F.regexp_replace(F.substr(value, F.lit(1), i), f"[^{of}]", ""))
    return F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.length(value)),
            lambda i: F.when(F.rlike(letter(i), F.lit(f"[{of}]")), F.substr(fresh, seen(i), F.lit(1))).otherwise(letter(i)),
        ),
        "",
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(digits: Column, doubled_first: int) -> Column:
    """Luhn sum from the right; every second digit counts double, from the given place on."""
    def weight(i: Column) -> Column:
        d = F.substr(F.reverse(digits), i, F.lit(1)).cast("int")
        return F.when(
            i % 2 == doubled_first, d * 2 - F.when(d > 4, 9).otherwise(0)
        ).otherwise(d)

    return F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + weight(i)
    )


def _card(key: str, value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    payload = _permute_digits(key, "card", F.substr(digits, F.lit(1), n - 1))
    check = (10 - _luhn_sum(payload, 1) % 10) % 10
    fresh = _refill(value, "0-9", F.concat(payload, check.cast("string")))
    return F.when(n.between(13, 19) & (_luhn_sum(digits, 0) % 10 == 0), fresh).otherwise(value)


def _ssn(key: str, value: Column) -> Column:
    area, group, serial = (F.substr(value, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, 2).otherwise(1)
    mixed = feistel(
        key, F.lit("ssn"), place, (group - 1) * 9999 + serial - 1, F.lit(SSN_AREAS), F.lit(SSN_REST)
    )
    fresh = F.format_string(
        "%03d-%02d-%04d",
        mixed["a"] + F.when(mixed["a"] >= 665, 2).otherwise(1),
        F.floor(mixed["b"] / 9999) + 1,
        mixed["b"] % 9999 + 1,
    )
    return F.when(valid, fresh).otherwise(value)


def _ipv4(key: str, value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: p.cast("int"))
    mixed = feistel(
        key, F.lit("ipv4"), parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], F.lit(65536), F.lit(65536)
    )
    fresh = F.concat_ws(
        ".", *(F.floor(mixed[h] / d) % 256 for h in ("a", "b") for d in (256, 1))
    )
    return F.when(F.forall(parts, lambda p: p < 256), fresh).otherwise(value)


def _day(key: str, day: Column) -> Column:
    """Pseudonym of a date within the range; null outside."""
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    mixed = feistel(
        key, F.lit("day"), F.floor(n / DAY_PARTS[1]), n % DAY_PARTS[1],
        F.lit(DAY_PARTS[0]), F.lit(DAY_PARTS[1]),
    )
    fresh = F.date_add(F.lit(FIRST_DAY).cast("date"), (mixed["a"] * DAY_PARTS[1] + mixed["b"]).cast("int"))
    return F.when(n.between(0, DAYS - 1), fresh)


def _date(key: str, value: Column) -> Column:
    """yyyy-mm-dd, dd.mm.yyyy, and dd/mm/yyyy or, where that is no day, mm/dd/yyyy."""
    y, m, d = (F.substr(value, F.lit(a), F.lit(n)) for a, n in ((1, 4), (6, 2), (9, 2)))
    a, b, c = (F.substr(value, F.lit(a), F.lit(n)) for a, n in ((1, 2), (4, 2), (7, 4)))
    day = lambda *p: F.concat_ws("-", *p).try_cast("date")
    iso, european, american = day(y, m, d), day(c, b, a), day(c, a, b)
    dots = F.substr(value, F.lit(3), F.lit(1)) == "."
    dashes = F.substr(value, F.lit(5), F.lit(1)) == "-"
    fresh = (
        F.when(dashes, F.date_format(_day(key, iso), "yyyy-MM-dd"))
        .when(dots, F.date_format(_day(key, european), "dd.MM.yyyy"))
        .when(european.isNotNull(), F.date_format(_day(key, european), "dd/MM/yyyy"))
        .otherwise(F.date_format(_day(key, american), "MM/dd/yyyy"))
    )
    return F.coalesce(fresh, value)


def _phone(key: str, value: Column) -> Column:
    country = F.regexp_extract(value, r"^\+[0-9]{1,3}", 0)
    rest = F.substr(value, F.length(country) + 1)
    return F.concat(country, _refill(rest, "0-9", _permute_digits(key, "phone", _digits(rest))))


def _email(key: str, value: Column) -> Column:
    """The name before the @ by letters and digits; the provider stays."""
    name = F.lower(F.substring_index(value, "@", 1))
    provider = F.substr(value, F.length(name) + 1)
    digits, letters = _digits(name), F.regexp_replace(name, "[^a-z]", "")
    fresh = _refill(
        _refill(name, "0-9", _permute_digits(key, "email", digits)),
        "a-z",
        _permute_letters(key, "email", letters),
    )
    return F.concat(fresh, provider)


NUMBERS: tuple[tuple[str, Callable[[str, Column], Column]], ...] = (
    (rf"^(?:{IPV4})$", _ipv4),
    (rf"^(?:{DATE})$", _date),
    (rf"^(?:{SSN})$", _ssn),
    (r"^[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$|[+(]", _phone),
)


def _number(key: str, value: Column) -> Column:
    """Pseudonym of one matched number or date; what does not validate comes back unchanged."""
    out = F.when(F.lit(False), value)
    for pattern, change in NUMBERS:
        out = out.when(F.rlike(value, F.lit(pattern)), change(key, value))
    return out.otherwise(_card(key, value))


def _spare(columns: list[str], name: str) -> str:
    while name in columns:
        name += "_"
    return name


def _replace(
    docs: DataFrame, total: str, maybe: Column, pattern: str, change: Callable[[Column], Column]
) -> DataFrame:
    """Change every match of a pattern in `text`; add the number of changed values to `total`."""
    text = F.col("text")
    pieces = _spare(docs.columns, "_pieces")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = docs.withColumn(
        pieces,
        F.when(maybe, F.struct(found.alias("old"), F.transform(found, change).alias("new"))),
    )
    old, new = F.col(pieces)["old"], F.col(pieces)["new"]
    filled = F.array_join(
        F.zip_with(
            F.split(text, pattern, -1),
            F.concat(new, F.array(F.lit(""))),
            lambda gap, value: F.concat(gap, value),
        ),
        "",
    )
    changed = F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x))
    hit = F.coalesce(F.size(old), F.lit(0)) > 0
    put = {
        "text": F.when(hit, filled).otherwise(text),
        total: F.col(total) + F.when(hit, changed).otherwise(0),
    }
    return kept.select(*(put[c].alias(c) if c in put else F.col(f"`{c}`") for c in docs.columns))


def mask(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """`docs` with pseudonyms in `text`; `count` names an added column of replaced values."""
    if not key:
        raise ValueError("an empty key protects nothing")
    total = count or _spare(docs.columns, "_replaced")
    out = docs.withColumn(total, F.lit(0))
    out = _replace(out, total, F.contains("text", F.lit("@")), EMAIL, lambda v: _email(key, v))
    out = _replace(
        out, total, F.rlike("text", F.lit("[0-9]")), NUMBER, lambda v: _number(key, v)
    )
    return out if count else out.drop(total)
