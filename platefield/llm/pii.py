"""Personal data replaced by format-preserving pseudonyms.

Numbers and dates are found by pattern, validated (Luhn, mod 97, octets, issued ranges,
calendar) and permuted by a keyed Feistel network inside their own format: a card stays
a card with a right check digit, a date a date of its century. The permutation depends
on the key, the kind and the value without its separators alone, so equal values get
equal pseudonyms in all documents. What isn't valid is left as it is.

Every place where a pattern matches is tried, also inside a match that isn't valid and over its
end, from left to right; the first valid value is taken and the next is sought behind it. An account
ends where its country says; numbers of unregistered countries are no accounts.

A value is a vector of digits with a radix each. A round adds a keyed hash of one half,
modulo the radices, to the other half; whatever the radices are, that can be undone, so
no cycle walking is needed. DataFrame functions only.

Defined results: a NULL text stays NULL with no values; empty texts stay empty; repeated
rows are rows of their own; an empty table stays empty; other columns are kept as they are, but pii_kinds is
replaced. Texts are read whole.
The key is part of the query plan: keep plans and event logs as private as the key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import nested, unnested

ROUNDS = 10

#: Patterns in order of precedence. None can match the empty text, and each is bounded or
#: possessive, so a long run of letters or digits costs no more than its length.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?!\d|[./-]\d)",
    "ip": r"(?<!\d|\d\.)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "ssn": r"(?<!\d|\d-)\d{3}-\d{2}-\d{4}(?!\d|-\d)",
    "card": r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)",
    "phone": r"(?<![\d+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\d)",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

#: What every valid value has. Quick to look for, and most texts have nothing of it.
SIGN = r"\d[\d ./()-]{5,}\d|@|[A-Z]{2}\d{2}"

#: Letters and digits of an account by country.
ACCOUNT = {
    int(n): codes.split()
    for n, codes in (row.split(":") for row in (
        "15:NO", "16:BE", "18:DK FI FK FO GL NL SD", "19:MK SI", "20:AT BA EE KZ LT LU MN XK", "21:CH HR LI LV",
        "22:BG BH CR DE GB GE IE ME RS VA", "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG", "25:LY PT ST",
        "26:IS TR", "27:BI DJ FR GR IT MC MR SM", "28:AL AZ BY CY DO GT HN HU LB NI PL SV", "29:BR EG PS QA UA", "30:JO KW MU YE",
        "31:MT SC", "32:LC", "33:RU",
    ))
}

PIECES = "array<struct<text:string,kind:string>>"
#: The pieces found so far, in runs of RUN so that adding one doesn't copy all, and how much of the last value lies ahead.
FOUND = f"struct<ahead:int,runs:array<{PIECES}>,last:{PIECES}>"
RUN = 256

#: Days of a century as a product of two radices, by whether its first year is a leap year.
LEAP_CENTURY, CENTURY = (75, 487), (92, 397)
INTS = "array<int>"


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _chars(s: Column) -> Column:
    """Letters and digits of ``s``, in lower case."""
    return F.filter(F.split(F.lower(s), ""), lambda c: c.rlike("^[a-z0-9]$"))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _code(c: Column) -> Column:
    return F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(97)


def _radix(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 10).otherwise(26)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def luhn_digit(payload: Column) -> Column:
    """The check digit of a text of digits."""
    digits = F.reverse(F.split(payload, ""))
    doubled = F.transform(
        F.filter(digits, lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return (10 - _sum(doubled) % 10) % 10


def mod97(s: Column) -> Column:
    """The remainder of an account number, letters as 10 to 35."""
    return F.aggregate(
        _chars(s), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 87) % 97
    )


def iban_check(country: Column, account: Column) -> Column:
    return F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")


def _date_parts(m: Column) -> tuple[Column, Column, Column, Column]:
    """Year, month, day and whether the day comes before the month."""
    part = lambda i: F.element_at(F.split(m, "[./-]"), i).cast("int")
    year_first = m.contains("-")
    day_first = m.contains(".") | (part(1) > 12)
    year = F.when(year_first, part(1)).otherwise(part(3))
    month = F.when(year_first | day_first, part(2)).otherwise(part(1))
    day = F.when(year_first, part(3)).when(day_first, part(1)).otherwise(part(2))
    return year, month, day, day_first


def _date(m: Column) -> Column:
    """The day, or NULL if there is none such."""
    year, month, day, _ = _date_parts(m)
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def kind_of(m: Column) -> Column:
    """The kind of a match, or NULL if it isn't valid."""
    d = _digits(m)
    plain = F.regexp_replace(m, " ", "")
    octets = F.split(m, r"\.")
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    year = _date_parts(m)[0]
    valid = {
        "email": F.lit(True),
        "iban": mod97(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))) == 1,
        "date": _date(m).isNotNull() & (year > 0),
        "ip": F.forall(octets, lambda o: o.cast("int") <= 255),
        "ssn": (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0),
        "card": (luhn_digit(F.substr(d, F.lit(1), F.length(d) - 1)) == F.substr(d, F.length(d)).cast("int")) & ~d.rlike("^0*$"),
        "phone": (F.length(d) >= 8) & (F.length(d) <= 15),
    }
    kind = None
    for k, p in PATTERNS.items():
        condition, value = m.rlike(f"^(?:{_bare(p)})$"), F.when(valid[k], F.lit(k))
        kind = F.when(condition, value) if kind is None else kind.when(condition, value)
    return kind


def _bare(pattern: str) -> str:
    """A pattern without what it asks of its surroundings."""
    return re.sub(r"^\(\?<!(?:[^()]|\[[^\]]*\])*\)|\(\?!(?:[^()]|\[[^\]]*\])*\)$", "", pattern)


def _country_code(m: Column) -> Column:
    return F.regexp_extract(m, r"^\+([17]|[2-9]\d)", 1)


def encode(m: Column, kind: Column) -> Column:
    """Digits, radices and tweak of a value; for a date also its century's first day."""
    d = _digits(m)
    payload = (
        F.when(kind == "card", F.substr(d, F.lit(1), F.length(d) - 1))
        .when(kind == "phone", F.substr(d, F.length(_country_code(m)) + 1))
        .when(kind == "iban", F.substr(F.regexp_replace(m, " ", ""), F.lit(5)))
        .otherwise(F.substring_index(m, "@", 1))
    )
    vector = lambda digits, radices, tweak, first: F.struct(
        digits.cast(INTS).alias("digits"), radices.cast(INTS).alias("radices"),
        F.concat_ws("|", kind, tweak).alias("tweak"), first.cast("date").alias("first"),
    )
    never = F.lit(None)

    def dated(day: Column) -> Column:
        century = F.floor(F.year(day) / 100).cast("int")
        first = F.make_date(century * 100, F.lit(1), F.lit(1))
        high, low = (F.when(century % 4 == 0, a).otherwise(b) for a, b in zip(LEAP_CENTURY, CENTURY))
        at = F.datediff(day, first)
        return vector(F.array(F.floor(at / low).cast("int"), at % low), F.array(high, low), century.cast("string"), first)

    area = F.substring(m, 1, 3).cast("int")
    issued = F.array(area - 1 - F.when(area > 666, 1).otherwise(0), F.substring(m, 5, 2).cast("int") - 1, F.substring(m, 8, 4).cast("int") - 1)
    tweak = F.when(kind == "email", F.lower(F.substring_index(m, "@", -1))).when(kind == "iban", F.substring(m, 1, 2)).otherwise("")
    return (
        F.when(kind == "date", let(_date(m), dated))
        .when(kind == "ip", vector(F.transform(F.split(m, r"\."), lambda o: o.cast("int")), F.array_repeat(F.lit(256), 4), F.lit(""), never))
        .when(kind == "ssn", vector(issued, F.array(F.lit(898), F.lit(99), F.lit(9999)), F.lit(""), never))
        .otherwise(let(_chars(payload), lambda c: vector(F.transform(c, _code), F.transform(c, _radix), tweak, never)))
    )


def feistel(digits: Column, radices: Column, tweak: Column, key: str) -> Column:
    """A keyed permutation of the vectors with these radices."""
    half = F.floor(F.size(digits) / 2).cast("int")

    def one_round(state: Column, r: Column) -> Column:
        first = r % 2 == 0
        other = F.when(first, F.slice(state, half + 1, F.size(state) - half)).otherwise(F.slice(state, F.lit(1), half))
        fixed = F.concat_ws("|", F.lit(key), tweak, r.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))

        def shifted(x: Column, i: Column) -> Column:
            noise = F.conv(F.substring(F.sha2(F.concat_ws("|", fixed, i.cast("string")), 256), 1, 12), 16, 10).cast("long")
            radix = F.element_at(radices, i + 1)
            return F.when((i < half) == first, ((x + noise) % radix).cast("int")).otherwise(x)

        return F.transform(state, shifted)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), digits, one_round)


def _fill(shape: Column, new: Column) -> Column:
    """``shape`` with its letters and digits replaced in order; capitals stay capitals."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        own = F.substr(new, acc["at"], F.lit(1))
        put = F.when(c.rlike("^[A-Z]$"), F.upper(own)).when(c.rlike("^[a-z0-9]$"), own).otherwise(c)
        return F.struct(F.concat(acc["out"], put).alias("out"), (acc["at"] + c.rlike("^[A-Za-z0-9]$").cast("int")).alias("at"))

    return F.aggregate(F.split(shape, ""), start, step, lambda acc: acc["out"])


def decode(m: Column, kind: Column, v: Column, digits: Column) -> Column:
    """The text of a permuted value, in the format of ``m``; ``v`` is what encode gave."""
    numbers = F.array_join(F.transform(digits, lambda x: x.cast("string")), ".")
    chars = F.array_join(
        F.zip_with(digits, v["radices"], lambda x, r: F.when(r == 26, F.chr(x + 97)).otherwise(x.cast("string"))), ""
    )

    def dated(day: Column) -> Column:
        return (
            F.when(m.contains("-"), F.date_format(day, "yyyy-MM-dd"))
            .when(m.contains("."), F.date_format(day, "dd.MM.yyyy"))
            .when(F.substring_index(m, "/", 1).cast("int") > 12, F.date_format(day, "dd/MM/yyyy"))
            .otherwise(F.date_format(day, "MM/dd/yyyy"))
        )

    place = lambda i: F.try_element_at(digits, F.lit(i))
    area = place(1) + 1 + F.when(place(1) >= 665, 1).otherwise(0)
    issued = F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in ((area, 3), (place(2) + 1, 2), (place(3) + 1, 4))])
    country = F.lower(F.substring(m, 1, 2))
    return (
        F.when(kind == "ip", numbers)
        .when(kind == "date", let(F.date_add(v["first"], place(1) * F.element_at(v["radices"], 2) + place(2)), dated))
        .when(kind == "ssn", issued)
        .when(kind == "card", let(chars, lambda c: _fill(m, F.concat(c, luhn_digit(c).cast("string")))))
        .when(kind == "phone", _fill(m, F.concat(_country_code(m), chars)))
        .when(kind == "iban", let(chars, lambda c: _fill(m, F.concat(country, iban_check(country, c), c))))
        .otherwise(F.concat(_fill(F.substring_index(m, "@", 1), chars), F.lit("@"), F.substring_index(m, "@", -1)))
    )


def reading(m: Column) -> Column:
    """The value of a match with its kind, or NULL: an account is the groups that have its country's length."""
    groups = F.split(m, " ")
    due = F.coalesce(*[F.when(F.substring(m, 1, 2).isin(codes), F.lit(n)) for n, codes in ACCOUNT.items()])
    ends = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
    account = F.try_element_at(F.filter(ends, lambda o: F.length(F.regexp_replace(o, " ", "")) == due), F.lit(1))
    value = F.when(m.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]*$"), account).otherwise(m)
    return let(let(value, lambda o: F.struct(o.alias("text"), kind_of(o).alias("kind"))), lambda r: F.when(r["kind"].isNotNull(), r))


def pieces(text: Column) -> Column:
    """The pieces of a text in order, values with their kind.

    The text is cut at every place where a pattern matches, so a piece begins with the only
    place in it that can hold a value; a value may reach over the pieces behind it.
    """
    matches = F.regexp_extract_all(text, F.lit(f"(?=({ANY}))"), F.lit(1))
    piece = lambda text, kind: F.struct(text.alias("text"), F.lit(kind).cast("string").alias("kind") if kind is None else kind.alias("kind"))
    none = F.array().cast(PIECES)

    def step(found: Column, x: Column) -> Column:
        own, ahead = F.length(x["text"]), found["ahead"]

        def grown(value: Column) -> Column:
            new = F.when(ahead >= own, none).when(ahead > 0, F.array(piece(F.substr(x["text"], ahead + 1), None)))
            taken = F.length(value["text"])
            new = (
                new.when(value.isNull(), F.array(piece(x["text"], None)))
                .when(taken >= own, F.array(value))
                .otherwise(F.array(value, piece(F.substr(x["text"], taken + 1), None)))
            )
            left = F.when(ahead > 0, ahead - own).otherwise(F.coalesce(taken, F.lit(0)) - own)
            full = F.size(found["last"]) >= RUN
            return F.struct(
                F.greatest(left, F.lit(0)).alias("ahead"),
                F.when(full, F.array_append(found["runs"], found["last"])).otherwise(found["runs"]).alias("runs"),
                F.concat(F.when(full, none).otherwise(found["last"]), new.cast(PIECES)).alias("last"),
            ).cast(FOUND)

        return let(F.when(ahead == 0, reading(x["match"])), grown)

    def cut(parts: Column) -> Column:
        """``parts``: the text cut, and what matches at each cut. No part stands before a match at the very start."""
        gaps, matches = parts["gaps"], parts["matches"]
        before = F.size(gaps) - F.size(matches)
        tried = F.zip_with(F.slice(gaps, before + 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("text"), m.alias("match")))
        start = F.struct(
            F.lit(0).alias("ahead"), F.array().alias("runs"),
            F.when(before > 0, F.array(piece(F.element_at(gaps, 1), None))).otherwise(none).alias("last"),
        ).cast(FOUND)
        return F.aggregate(tried, start, step, lambda f: F.concat(F.flatten(f["runs"]), f["last"]))

    return let(F.struct(F.split(text, f"(?={ANY})", -1).alias("gaps"), matches.alias("matches")), cut)


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The new text of a value."""
    permuted = lambda v: let(feistel(v["digits"], v["radices"], v["tweak"], key), lambda d: decode(m, kind, v, d))
    return let(encode(m, kind), permuted)


def pseudonymise(docs: DataFrame, text: str = "text", key: str = "change-me") -> DataFrame:
    """``docs`` with ``text`` rewritten and ``pii_kinds``, the kinds of its values in order."""
    source = F.col("_row").getField(text)
    hit = source.rlike(SIGN) & source.rlike(ANY)
    done = nested(docs).withColumn("found", F.when(hit, pieces(source)))
    texts = F.transform("found", lambda p: F.when(p["kind"].isNull(), p["text"]).otherwise(pseudonym(p["text"], p["kind"], key)))
    kinds = F.filter(F.transform("found", lambda p: p["kind"]), lambda k: k.isNotNull())
    rewritten = F.when(F.col("found").isNotNull(), F.array_join(texts, "")).otherwise(source)
    return unnested(done, docs.columns, **{text: rewritten, "pii_kinds": F.coalesce(kinds, F.array().cast("array<string>"))})
