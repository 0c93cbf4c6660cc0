r"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Numbers and dates are found by pattern and validated; each valid one is split in two parts (L, R) of a
domain M_L x M_R and goes through ROUNDS rounds in which one part has a keyed SHA-256 value of the other
added, modulo its size. That is a permutation of exactly the valid values of the format, so equal values
keep equal pseudonyms in all documents, different ones different, and the key holder can undo it.

Formats: payment cards (13 to 19 digits together, or in groups of four or 4-6-5; valid Luhn digit, kept valid); dates as
YYYY-MM-DD, DD.MM.YYYY or DD/MM/YYYY from 1900 to 2099; dotted IPv4 addresses; US social security
numbers with valid area, group and serial; phone numbers, as +N (NNN) NNN-NNNN and the like (the country code
stays); and the local part of e-mail addresses, letter for letter and digit for digit.
What fails validation stays as it is. Separators stay.

Defined results: null text gives null text and counts of 0; an empty text stays. Rows that repeat an id
are each handled; a null id is kept. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Patterns of the formats, tried in this order at each place.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ -]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
}
_ANY = "|".join(FORMATS.values())
_FIRST, _DAYS, _DAY_L = "1900-01-01", 73_049, 17  # 73,049 days = 17 * 4,297
_AREAS, _SERIALS = 898, 99 * 9_999


def _prf(key: str, kind: str, step: Column, value: Column) -> Column:
    """60 bits of a keyed hash."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), value.cast("string")).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def _feistel(key: str, kind: str, left: Column, right: Column, of_left: Column, of_right: Column) -> Column:
    """struct(l, r) after all rounds."""

    def one(s: Column, i: Column) -> Column:
        return F.struct(
            F.when(i % 2 == 1, F.pmod(s["l"] + F.pmod(_prf(key, kind, i, s["r"]), of_left), of_left)).otherwise(s["l"]).alias("l"),
            F.when(i % 2 == 0, F.pmod(s["r"] + F.pmod(_prf(key, kind, i, s["l"]), of_right), of_right)).otherwise(s["r"]).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), one)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _part(text: Column, start, length) -> Column:
    whole = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substr(text, whole(start), whole(length))


def _padded(number: Column, width: Column) -> Column:
    """Decimal digits with zeros in front; a width up to 18."""
    return F.right(F.concat(F.lit("0" * 18), number.cast("string")), width)


def _fill(shape: Column, digits: Column) -> Column:
    """The digits in the places of the shape's own."""
    at = lambda i: F.length(_digits(_part(shape, 1, i + 1)))
    return F.array_join(F.transform(F.split(shape, ""), lambda c, i: F.when(c.rlike("[0-9]"), _part(digits, at(i), 1)).otherwise(c)), "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum from the last digit on, with every second digit doubled (from the last one if doubled is 0)."""
    worth = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    parts = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == doubled, worth(F.try_to_number(c, F.lit("9")).cast("int"))).otherwise(F.try_to_number(c, F.lit("9")).cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _halves(digits: Column, key: str, kind: str) -> Column:
    """A digit string permuted among those of its length (up to 18)."""
    n = F.length(digits)
    u = (n / 2).cast("int")
    s = _feistel(key, kind, _part(digits, 1, u).cast("long"), _part(digits, u + 1, n - u).cast("long"), F.pow(F.lit(10), u).cast("long"), F.pow(F.lit(10), n - u).cast("long"))
    return F.concat(_padded(s["l"], u), _padded(s["r"], n - u))


def _card(value: Column, key: str) -> Column:
    digits = _digits(value)
    body = _part(digits, 1, F.length(digits) - 1)
    new = _halves(body, key, "card")
    return F.when(_luhn_sum(digits, 1) % 10 == 0, _fill(value, F.concat(new, ((10 - _luhn_sum(new, 0) % 10) % 10).cast("string"))))


def _phone(value: Column, key: str) -> Column:
    digits = _digits(value)
    n = F.length(digits) - 10
    return _fill(value, F.concat(_part(digits, 1, n), _halves(_part(digits, n + 1, 10), key, "phone")))


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (_part(value, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = F.when(area > 666, area - 2).otherwise(area - 1)
    s = _feistel(key, "ssn", rank, (group - 1) * 9_999 + serial - 1, F.lit(_AREAS).cast("long"), F.lit(_SERIALS).cast("long"))
    new_area = F.when(s["l"] >= 665, s["l"] + 2).otherwise(s["l"] + 1)
    number = F.concat(_padded(new_area, F.lit(3)), F.lit("-"), _padded(F.floor(s["r"] / 9_999) + 1, F.lit(2)), F.lit("-"), _padded(F.pmod(s["r"], F.lit(9_999)) + 1, F.lit(4)))
    return F.when(valid, number)


def _ip(value: Column, key: str) -> Column:
    octets = F.split(value, r"\.")
    valid = F.forall(octets, lambda o: (o.cast("int") <= 255) & ((F.length(o) == 1) | ~o.startswith("0")))
    pair = lambda i: F.get(octets, F.lit(i)).cast("long") * 256 + F.get(octets, F.lit(i + 1)).cast("long")
    size = F.lit(65_536).cast("long")
    s = _feistel(key, "ip", pair(0), pair(2), size, size)
    return F.when(valid, F.concat_ws(".", *[f(s[k]) .cast("string") for k in ("l", "r") for f in (lambda x: F.floor(x / 256), lambda x: F.pmod(x, F.lit(256)))]))


def _date(value: Column, key: str) -> Column:
    shape = F.when(value.contains("."), F.lit("dd.MM.yyyy")).when(value.contains("/"), F.lit("dd/MM/yyyy")).otherwise(F.lit("yyyy-MM-dd"))
    sort = lambda f: F.try_to_timestamp(value, F.lit(f)).cast("date")
    day = F.when(value.contains("."), sort("dd.MM.yyyy")).when(value.contains("/"), sort("dd/MM/yyyy")).otherwise(sort("yyyy-MM-dd"))
    number = F.datediff(day, F.lit(_FIRST).cast("date")).cast("long")
    s = _feistel(key, "date", F.pmod(number, F.lit(_DAY_L)), F.floor(number / _DAY_L), F.lit(_DAY_L).cast("long"), F.lit(_DAYS // _DAY_L).cast("long"))
    new = F.date_add(F.lit(_FIRST).cast("date"), (s["r"] * _DAY_L + s["l"]).cast("int"))
    text = F.when(shape == "dd.MM.yyyy", F.date_format(new, "dd.MM.yyyy")).when(shape == "dd/MM/yyyy", F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "yyyy-MM-dd"))
    return F.when((number >= 0) & (number < _DAYS), text)


def _email(value: Column, key: str) -> Column:
    local = F.substring_index(value, "@", 1)
    u = (F.length(local) / 2).cast("int")

    def shifted(text: Column, other: Column, step: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), step.cast("string"), other).cast("binary"), 256)
        by = lambda i: F.conv(_part(stream, F.pmod(i, F.lit(32)) * 2 + 1, 2), 16, 10).cast("int")
        turn = lambda c, i, first, size: F.chr(F.lit(first) + F.pmod(F.ascii(c) - first + by(i), F.lit(size)))
        return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike("[0-9]"), turn(c, i, 48, 10)).when(c.rlike("[a-z]"), turn(c, i, 97, 26)).when(c.rlike("[A-Z]"), turn(c, i, 65, 26)).otherwise(c)), "")

    def one(s: Column, i: Column) -> Column:
        return F.struct(F.when(i % 2 == 1, shifted(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(i % 2 == 0, shifted(s["r"], s["l"], i)).otherwise(s["r"]).alias("r"))

    s = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(_part(local, 1, u).alias("l"), _part(local, u + 1, F.length(local) - u).alias("r")), one)
    return F.concat(s["l"], s["r"], _part(value, F.length(local) + 1, F.length(value)))


_MAKERS = {"email": _email, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}
#: How a found value shows its format (the first that fits).
_TELLS = {
    "email": "@", "date": r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})$", "ip": r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "phone": r"^(?:\+[0-9]{1,3}[ -]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}$", "card": "[0-9]",
}


def _named(value: Column, key: str) -> Column:
    """struct(kind, pseudonym) of a found value; the pseudonym is null if it isn't valid."""
    kind, new = None, None
    for k, tell in _TELLS.items():
        fits = value.rlike(tell)
        kind = F.when(fits, F.lit(k)) if kind is None else kind.when(fits, F.lit(k))
        made = _MAKERS[k](value, key)
        new = F.when(fits, made) if new is None else new.when(fits, made)
    return F.struct(kind.alias("kind"), new.alias("new"), value.alias("old"))


def pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, found (array of kind, new, old; new is null where the value isn't valid), text with pseudonyms."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    some = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(_ANY), F.lit(0)))
    rows = rows.withColumn("values", some)
    found = rows.withColumn("found", F.when(F.size("values") > 0, F.transform("values", lambda v: _named(v, key))))
    found = found.withColumn("gaps", F.when(F.col("found").isNotNull(), F.split("text", _ANY, -1)))
    parts = F.zip_with(F.slice("gaps", F.lit(2), F.size("gaps")), "found", lambda gap, f: F.concat(F.coalesce(f["new"], f["old"]), gap))
    text = F.when(F.col("found").isNotNull(), F.concat(F.get("gaps", F.lit(0)), F.array_join(parts, ""))).otherwise(F.col("text"))
    return found.select("doc_id", "found", text.alias("text"))


def pii_report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the number of pseudonyms of each kind (n_email, ...), n_invalid, and the text with pseudonyms."""
    valid = lambda k: F.size(F.filter("found", lambda f: (f["kind"] == k) & f["new"].isNotNull()))
    whole = lambda c: F.coalesce(F.when(F.col("found").isNotNull(), c), F.lit(0)).cast("long")
    counts = [whole(valid(k)).alias(f"n_{k}") for k in FORMATS]
    invalid = whole(F.size(F.filter("found", lambda f: f["new"].isNull()))).alias("n_invalid")
    return pseudonyms(docs, key).select("doc_id", *counts, invalid, "text")
