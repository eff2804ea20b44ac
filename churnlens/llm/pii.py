"""Format-preserving pseudonyms for personal numbers, dates and addresses.

One regular expression finds candidates; each is validated (Luhn and mod-97
checks, ranges, calendar) and what passes is replaced by a keyed permutation of
its own format: a Feistel network over a vector of digits, letters, octets or
mixed-radix numbers, whose rounds add a SHA-512 stream of the other half modulo
each position's radix. It is a bijection on the format, so equal values get equal
pseudonyms in every document and different values different ones, and check
digits are set anew, so pseudonyms validate. Separators, lengths, letter case and
the kept parts (first card digit, IBAN country, country code and first digit of
each group of a phone number, mail domain) stay.

The patterns of cards and accounts take neighbouring numbers and capitals along. So
their usual groupings (``FORMS``: lengths by country, 4-4-4-4 and so on) are sought
first, from every place of the text, overlaps included; those that validate are
taken, and the patterns search what lies between them.

Slashed dates are read month first if that is possible and day first otherwise.
Everything is DataFrame functions. Null and empty texts and texts without a
validated value stay as they are; other columns are left alone; an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import fresh

ROUNDS = 8
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
YEAR, DAY, MONTH = r"(?:1[89]|2[01])\d\d", r"(?:0?[1-9]|[12]\d|3[01])", r"(?:0?[1-9]|1[0-2])"
#: In the order in which they are tried at one place of the text.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)",
    "iso_date": rf"(?<![\d-]){YEAR}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])",
    "dot_date": rf"(?<![\d.]){DAY}\.{MONTH}\.{YEAR}(?!\.?\d)",
    "slash_date": rf"(?<![\d/]){DAY}/{DAY}/{YEAR}(?![\d/])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\d-])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Characters of an account number, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_ACCOUNTS = "|".join(
    rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f"(?: ?[A-Z0-9]{{{n % 4}}})" if n % 4 else "")
    for n, c in IBAN_LENGTHS.items())
#: What may be around an account and a card: no part of a longer one, of an address or of a dashed name.
AROUND_IBAN = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])(?![A-Za-z0-9._%+-]{0,63}@)"
AROUND_CARD = (r"(?<![\d+])(?<!(?<!\d)-)(?<!(?<![A-Za-z0-9])[A-Z]{2})",
               r"(?!\d)(?!-(?!\d))(?![A-Za-z0-9._%+-]{0,63}@)")
#: Groupings in which accounts and cards are written, longer ones first.
FORMS = [(AROUND_IBAN, f"(?:{_ACCOUNTS})"), (AROUND_IBAN, KINDS["iban"])] + [(AROUND_CARD, form) for form in (
    r"\d{4}(?:[ -]\d{4}){3}[ -]\d{3}", r"\d{4}(?:[ -]\d{4}){3}", r"\d{4}[ -]\d{6}[ -]\d{5}", r"\d{4}[ -]\d{6}[ -]\d{4}",
    r"(?<!\+\d{1,3}[ .-])\d{13,19}")]
#: 400 Gregorian years are 146097 = 189 * 773 days.
ERA_START, ERA = "1800-01-01", (189, 773)


def chars(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda k: F.substring(s, k, F.lit(1)))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def longs(*values) -> Column:
    return F.array(*[(v if isinstance(v, Column) else F.lit(v)).cast("long") for v in values])


def feistel(values: Column, radices: Column, tweak: Column, key: str, rounds: int = ROUNDS) -> Column:
    """Keyed bijection on the vectors with ``0 <= values[k] < radices[k]``."""
    half = F.floor(F.size(values) / F.lit(2)).cast("int")
    rest = F.size(values) - half
    left_radix, right_radix = F.slice(radices, F.lit(1), half), F.slice(radices, half + 1, rest)

    def shifted(part: Column, radix: Column, other: Column, k: Column) -> Column:
        shown = F.concat_ws("|", F.lit(key), tweak, k.cast("string"),
                            F.array_join(F.transform(other, lambda v: v.cast("string")), ","))
        stream = let(shown, lambda x: F.array_join(F.transform(
            F.sequence(F.lit(0), F.floor(F.size(part) / F.lit(16)).cast("int")),
            lambda c: F.sha2(F.concat_ws("|", x, c.cast("string")), 512)), ""))
        return let(stream, lambda bits: F.transform(part, lambda v, j: F.pmod(
            v + F.conv(F.substring(bits, j * 8 + 1, F.lit(8)), 16, 10).cast("long"), F.get(radix, j))))

    start = F.struct(F.slice(values, F.lit(1), half).alias("l"), F.slice(values, half + 1, rest).alias("r"))
    done = F.aggregate(
        F.array(*map(F.lit, range(rounds))), start,
        lambda s, k: F.when(k % 2 == 0, F.struct(s["l"].alias("l"), shifted(s["r"], right_radix, s["l"], k).alias("r")))
        .otherwise(F.struct(shifted(s["l"], left_radix, s["r"], k).alias("l"), s["r"].alias("r"))),
        lambda s: F.concat(s["l"], s["r"]))
    return done


def luhn(number: Column) -> Column:
    """Luhn sum modulo 10 of a digit string (0: valid)."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.transform(F.reverse(chars(number)), lambda c, k: F.when(
        k % 2 == 1, doubled(F.ascii(c) - 48)).otherwise(F.ascii(c) - 48)), F.lit(0), lambda a, d: a + d) % 10


def mod97(s: Column) -> Column:
    """Letters as 10 to 35, the decimal number modulo 97."""
    return F.aggregate(chars(s), F.lit(0), lambda a, c: F.when(
        c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def kind_of(m: Column) -> Column:
    """The kind of a match, by its form."""
    return (F.when(m.contains("@"), F.lit("email"))
            .when(m.rlike(r"^[A-Z]"), F.lit("iban"))
            .when(m.rlike(r"^\d{4}-\d\d-\d\d$"), F.lit("ymd"))
            .when(m.rlike(r"^\d+\.\d+\.\d{4}$"), F.lit("dmy"))
            .when(m.rlike(r"^(?:0?\d|1[0-2])/\d+/\d{4}$"), F.lit("mdy"))
            .when(m.rlike(r"^\d+/\d+/\d{4}$"), F.lit("dmy"))
            .when(m.rlike(r"^\d+(?:\.\d+){3}$"), F.lit("ipv4"))
            .when(m.rlike(r"^\d{3}-\d\d-\d{4}$"), F.lit("ssn"))
            .when(m.rlike(r"^[+(]|^\d{3}[ .-]\d{3}[ .-]\d{4}$"), F.lit("phone"))
            .otherwise(F.lit("card")))


def compact(m: Column) -> Column:
    """A card's or account's characters without separators."""
    return F.regexp_replace(m, "[ -]", "")


def by_kind(kind: Column, **values: Column) -> Column:
    """The value for the kind; null for kinds that are not named."""
    out = None
    for name, value in values.items():
        hit = kind.isin(*name.split("_"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def permuted_part(m: Column, kind: Column) -> Column:
    """Of kinds that are permuted character by character: what is permuted."""
    d = compact(m)
    return by_kind(kind, email=F.substring_index(m, "@", 1), phone=m, card=F.substring(d, F.lit(2), F.length(d) - 2),
                   iban=F.substring(d, F.lit(5), F.length(d)))


def date_parts(m: Column, kind: Column) -> Column:
    number = lambda k: F.get(F.split(m, "[-./]"), F.lit(k)).cast("int")
    return F.struct(F.when(kind == "ymd", number(0)).otherwise(number(2)).alias("y"),
                    F.when(kind == "mdy", number(0)).otherwise(number(1)).alias("m"),
                    by_kind(kind, ymd=number(2), mdy=number(1), dmy=number(0)).alias("d"))


def first_of_month(p: Column) -> Column:
    return F.make_date(p["y"], p["m"], F.lit(1))


def is_valid(m: Column, kind: Column) -> Column:
    date = let(date_parts(m, kind), lambda p: F.when(
        p["m"].between(1, 12), p["d"] <= F.dayofmonth(F.last_day(first_of_month(p)))).otherwise(F.lit(False)))
    return by_kind(
        kind, email_ipv4=F.lit(True), ymd_mdy_dmy=date, phone=F.length(digits(m)).between(7, 15),
        ssn=~m.rlike(r"^(?:000|666|9)|-00-|-0000$"),
        card=let(compact(m), lambda d: (luhn(d) == 0) & ~d.rlike(r"^(\d)\1*$")),
        iban=let(compact(m), lambda d: mod97(F.concat(F.substring(d, F.lit(5), F.length(d)), F.substring(d, 1, 4))) == 1))


def vector(m: Column, kind: Column, part: Column) -> Column:
    """The vector of a match."""
    text = F.transform(chars(part), lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).when(
        c.between("a", "z"), F.ascii(c) - 97).when(c.between("A", "Z"), F.ascii(c) - 65).otherwise(F.lit(0)).cast("long"))
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("long"))
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    day = let(date_parts(m, kind), lambda p: F.datediff(first_of_month(p), F.lit(ERA_START).cast("date")) + p["d"] - 1)
    return by_kind(kind, email_phone_card_iban=text, ipv4=octets, ssn=longs(index, group - 1, serial - 1),
                   ymd_mdy_dmy=let(day, lambda x: longs(F.floor(x / F.lit(ERA[1])), x % ERA[1])))


def radices(m: Column, kind: Column, part: Column) -> Column:
    """The radix of each position; 1 where it stays."""
    stays = lambda k: (kind == "phone") & (
        ~F.substring(m, k, F.lit(2)).rlike(r"^\d\d$") | (k == 0) | F.substring(m, F.lit(1), k + 1).rlike(r"^\+\d{0,3}$"))
    text = F.transform(chars(part), lambda c, k: F.when(stays(k), F.lit(1)).when(c.between("0", "9"), F.lit(10)).when(
        c.between("a", "z") | c.between("A", "Z"), F.lit(26)).otherwise(F.lit(1)).cast("long"))
    return by_kind(kind, email_phone_card_iban=text, ipv4=longs(256, 256, 256, 256), ssn=longs(898, 99, 9999),
                   ymd_mdy_dmy=longs(*ERA))


def put(shape: Column, pattern: str, new: Column) -> Column:
    """``shape`` with its characters of a class replaced by those of ``new`` in order."""
    return F.array_join(F.transform(chars(shape), lambda c, k: F.when(c.rlike(pattern), F.substring(
        new, F.length(compact(F.substring(shape, F.lit(1), k + 1))), F.lit(1))).otherwise(c)), "")


def rebuilt(m: Column, kind: Column, part: Column, radix: Column, moved: Column) -> Column:
    """The pseudonym of a valid match from its permuted vector."""
    text = F.array_join(F.transform(chars(part), lambda c, k: F.when(F.get(radix, k) == 1, c).otherwise(F.char(
        F.get(moved, k) + F.when(c.between("0", "9"), F.lit(48)).when(c.between("a", "z"), F.lit(97)).otherwise(F.lit(65))))), "")
    number = lambda k: F.get(moved, F.lit(k))
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    day = F.date_add(F.lit(ERA_START).cast("date"), (number(0) * ERA[1] + number(1)).cast("int"))
    sep = F.regexp_extract(m, "([-./])", 1)
    short = F.length(m) < 10
    both = [F.when(short, F.date_format(day, f)).otherwise(F.date_format(day, f * 2)) for f in ("d", "M")]
    date = F.concat_ws("", *[x for k in range(3) for x in (by_kind(
        kind, ymd=(F.date_format(day, "yyyy"), both[1], both[0])[k], mdy=(both[1], both[0], F.date_format(day, "yyyy"))[k],
        dmy=(both[0], both[1], F.date_format(day, "yyyy"))[k]), *([sep] if k < 2 else []))])
    card = let(F.concat(F.substring(m, 1, 1), text), lambda body: put(m, "[0-9]", F.concat(
        body, ((F.lit(10) - luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))))
    iban = let(text, lambda own: put(m, "[A-Z0-9]", F.concat(
        F.substring(m, 1, 2), pad(F.lit(98) - mod97(F.concat(own, F.substring(m, 1, 2), F.lit("00"))), 2), own)))
    area = F.when(number(0) >= 665, number(0) + 2).otherwise(number(0) + 1)
    return by_kind(kind, email=F.concat(text, F.lit("@"), F.substring_index(m, "@", -1)), phone=text, card=card, iban=iban,
                   ipv4=F.array_join(F.transform(moved, lambda o: o.cast("string")), "."),
                   ssn=F.concat_ws("-", pad(area, 3), pad(number(1) + 1, 2), pad(number(2) + 1, 4)), ymd_mdy_dmy=date)


def pseudonyms(found: Column, key: str) -> Column:
    """The pseudonym of each match; the match itself where it does not validate."""
    tweak = lambda kind: F.when(kind.isin("ymd", "mdy", "dmy"), F.lit("date")).otherwise(kind)

    def new(m: Column) -> Column:
        return let(F.struct(kind_of(m).alias("kind")), lambda a: let(
            F.struct(permuted_part(m, a["kind"]).alias("part")), lambda b: F.when(~is_valid(m, a["kind"]), m).otherwise(let(
                F.struct(vector(m, a["kind"], b["part"]).alias("v"), radices(m, a["kind"], b["part"]).alias("r")), lambda c: let(
                    feistel(c["v"], c["r"], tweak(a["kind"]), key), lambda moved: rebuilt(
                        m, a["kind"], b["part"], c["r"], moved))))))

    return F.transform(found, new)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with its texts' personal values replaced, its columns as they were."""
    found, new = fresh(docs.columns, "found"), fresh(docs.columns, "new")
    return _replaced(docs, key, text, found, new).select(*docs.columns)


def private_values(docs: DataFrame, key: str) -> DataFrame:
    """Per row: doc_id, the new text, and how many values were replaced."""
    same = F.zip_with("found", "new", lambda a, b: a == b)
    return _replaced(docs.select("doc_id", "text"), key, "text", "found", "new").select(
        "doc_id", "text", F.size(F.filter(same, lambda x: ~x)).cast("long").alias("n_replaced"))


def usual_forms(text: Column) -> Column:
    """The valid cards and accounts of ``text`` in usual groupings, wherever they start."""
    at_any_place = [F.regexp_extract_all(text, F.lit(f"{before}(?=({form}){after})"), F.lit(1)) for (before, after), form in FORMS]
    return F.filter(F.array_distinct(F.concat(*at_any_place)), lambda m: is_valid(m, kind_of(m)))


def one_of(values: Column) -> Column:
    """The pattern of just these cards and accounts."""
    return F.array_join(F.transform(values, lambda v: F.when(v.rlike("^[A-Z]"), F.concat(
        F.lit(AROUND_IBAN[0]), v, F.lit(AROUND_IBAN[1]))).otherwise(F.concat(F.lit(AROUND_CARD[0]), v, F.lit(AROUND_CARD[1])))), "|")


def _replaced(docs: DataFrame, key: str, text: str, found: str, new: str) -> DataFrame:
    t = F.col(text)
    none = F.array().cast("array<string>")
    matches = lambda x: F.regexp_extract_all(x, F.lit(PATTERN), F.lit(0))
    between = lambda x: F.split(x, PATTERN, -1)
    sure, rest = fresh([*docs.columns, found, new], "sure"), fresh([*docs.columns, found, new], "rest")
    named = docs.withColumn(sure, F.when(t.rlike(r"\d(?:[ -]?[A-Z0-9]){11}"), usual_forms(t)).otherwise(none))
    some = F.size(sure) > 0
    named = named.withColumn(rest, F.when(some, F.split(t, one_of(F.col(sure)), -1)).otherwise(F.array(t)))
    named = named.withColumn(sure, F.when(some, F.regexp_extract_all(t, one_of(F.col(sure)), F.lit(0))).otherwise(none))
    in_order = F.flatten(F.transform(rest, lambda x, k: F.concat(matches(x), F.slice(sure, k + 1, 1))))
    match = F.when(some, in_order).when(t.rlike("[0-9@]"), matches(t)).otherwise(none)
    named = named.withColumn(found, match).withColumn(new, pseudonyms(F.col(found), key))
    gaps = F.when(some, F.flatten(F.transform(rest, between))).otherwise(between(t))
    after = F.zip_with(new, F.slice(gaps, F.lit(2), F.size(new)), lambda m, g: F.concat(m, g))
    joined = F.concat(F.get(gaps, F.lit(0)), F.array_join(after, ""))
    return named.withColumn(text, F.when(F.size(found) > 0, joined).otherwise(t))
