"""PII: format-preserving pseudonyms by keyed Feistel permutations, in column functions only.

Matches of the patterns below that are valid (a date that exists, a number whose check digit holds, an address within
its range) are replaced within the text by their image under a permutation of their own format: equal values have equal
images in all documents, different values different ones, and whoever has the key can undo it. The permutations:
`characters` keeps the class of each character (digit, lower, upper case; all others stay), halves of the value keying
each other; `radix` works on pairs of numbers below two bounds and so permutes exactly their product.

A match whose check fails may hold a valid value, glued to its neighbours. It is marked at its start and the text is
matched again: with fixed extents at a start that has one mark, without cards and account numbers at one of two, not at
all at one of three, as ever at all later places; until no match fails. Of overlapping valid values the first counts.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read

KEY = "pseudonym-key"
ROUNDS = 8

#: Patterns of the kinds, tried in this order at each place. Groups do not capture.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "date": r"(?<![A-Za-z0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2})(?:(?=T[0-9]{2}:[0-9]{2})|(?![A-Za-z0-9/-]))",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "ip": r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])",
    "card": r"(?<![A-Za-z0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:(?:\+1[\x20.-]?)?(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}|\+1[0-9]{10}|\+[2-9][0-9]{7,14}(?![A-Za-z0-9])|\+[2-9][0-9]{0,2}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,8}(?:[\x20.-][0-9]{2,8}){0,3})(?![A-Za-z0-9])",
}
ANY = "|".join(PATTERNS.values())
KINDS = tuple(PATTERNS)
#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Extents that do not depend on what follows: of one grouping, or of a country's length.
FIXED = {
    "iban": r"(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{4,5})(?![A-Za-z0-9])",
}
#: Characters of a window, and how many of its last ones may belong to a match that goes on: the longest that can fail has 54 and what it looks ahead at, each with up to three marks.
WINDOW, REACH = 1024, 256
#: The mark of a start whose match failed, and what stands for characters of the text that are used for marks.
MARK, ESCAPE = "\ufdd0", (("\ufdd1", "\ufdd1\ufdd2"), ("\ufdd0", "\ufdd1\ufdd3"))


def _after_marks(patterns: list[str], marks: int) -> str:
    """The patterns at a start with so many marks, which do not hide what stands before them."""
    moved = [re.sub(r"^\(\?<!(\[[^\]]*\])\)", lambda m: f"(?<!{m[1]}{MARK * marks})", x) for x in patterns]
    return f"(?<={MARK * marks})(?<!{MARK * (marks + 1)})(?:{'|'.join(moved)})"


MARKED = "|".join([rf"(?<!{MARK})(?:{ANY})", _after_marks([FIXED.get(k, x) for k, x in PATTERNS.items()], 1), _after_marks([x for k, x in PATTERNS.items() if k not in FIXED], 2)])
#: Dates from 1900-01-01 to 2099-12-31: 73,049 days, 17 * 4,297.
EPOCH, DATE_RADIX = "1900-01-01", (17, 4297)
#: Numbers of three areas, groups and serials: areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999.
SSN_RADIX = (898, 99 * 9999)
IP_RADIX = (65536, 65536)
#: Days above the twelfth that a year has before each month, leap days left out.
BEFORE_MONTH = (0, 19, 35, 54, 72, 91, 109, 128, 147, 165, 184, 202)
#: What the first digit of a telephone number's group is while it is permuted: 208 and 209 for 0 and 1, from 192 on for 2 to 9.
LEADING = "".join(map(chr, [208, 209, *range(192, 200)]))


def _hash(key: str, kind: str, i: Column, x: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string")), 512)


def _number(key: str, kind: str, i: Column, x: Column) -> Column:
    return F.conv(F.substring(_hash(key, kind, i, x), 1, 14), 16, 10).cast("long")


def _rounds(back: bool) -> Column:
    return F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))


def radix(index: Column, bounds: tuple[int, int], key: str, kind: str, back: bool = False) -> Column:
    """Permutation of 0 .. a * b - 1: the index as (index div b, index mod b), each moved by a hash of the other in turn; back undoes it."""
    way = -1 if back else 1
    a, b = bounds
    start = F.struct(F.floor(index / F.lit(b)).cast("long").alias("l"), (index % F.lit(b)).cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(s["l"] + way * _number(key, kind, i, s["r"]), F.lit(a))).otherwise(s["l"]).alias("l"),
            F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + way * _number(key, kind, i, s["l"]), F.lit(b))).alias("r"),
        )

    return F.aggregate(_rounds(back), start, step, lambda s: s["l"] * b + s["r"])


def characters(value: Column, key: str, kind: str, back: bool = False) -> Column:
    """Permutation of the strings with one class of character at each place; back undoes it."""
    way = -1 if back else 1

    def moved(half: Column, other: Column, i: Column) -> Column:
        stream = _hash(key, kind, i, other)

        def one(c: Column, k: Column) -> Column:
            shift = F.conv(F.substring(stream, (k % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            code = F.ascii(c)
            base = F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65).when(c.between(LEADING[2], LEADING[9]), 192).when(c.between(LEADING[0], LEADING[1]), 208)
            size = F.when(c.between("0", "9"), 10).when(c.between(LEADING[2], LEADING[9]), 8).when(c.between(LEADING[0], LEADING[1]), 2).otherwise(26)
            return F.when(base.isNull(), c).otherwise(F.char(base + F.pmod(code - base + way * shift, size)))

        return F.array_join(F.transform(F.split(half, ""), one), "")

    middle = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), middle).alias("l"), F.substring(value, middle + 1, F.length(value)).alias("r"))

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(F.when(odd, moved(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(odd, s["r"]).otherwise(moved(s["r"], s["l"], i)).alias("r"))

    return F.aggregate(_rounds(back), start, step, lambda s: F.concat(s["l"], s["r"]))


def luhn_sum(digits: Column, first: int) -> Column:
    """Check sum of the digits from the right; the rightmost counts `first` times (1 or 2)."""
    reversed_ = F.split(F.reverse(digits), "")

    def add(s: Column, c: Column) -> Column:
        times = F.when(s["k"] % 2 == 0, first).otherwise(3 - first)
        d = c.cast("int") * times
        return F.struct((s["t"] + F.when(d > 9, d - 9).otherwise(d)).alias("t"), (s["k"] + 1).alias("k"))

    return F.aggregate(reversed_, F.struct(F.lit(0).alias("t"), F.lit(0).alias("k")), add, lambda s: s["t"])


def mod97(text: Column) -> Column:
    """A string of digits and capitals (A is 10) modulo 97."""
    return F.aggregate(
        F.split(text, ""),
        F.lit(0),
        lambda s, c: F.when(c.between("0", "9"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97),
    )


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _bare(v: Column) -> Column:
    return F.replace(v, F.lit(" "), F.lit(""))


def _octets(v: Column) -> list[Column]:
    return [F.split_part(v, F.lit("."), F.lit(i)).cast("int") for i in range(1, 5)]


def _day(v: Column) -> Column:
    iso, slash = v.contains("-"), v.contains("/")
    slashed = F.coalesce(F.try_to_timestamp(v, F.lit("MM/dd/yyyy")), F.try_to_timestamp(v, F.lit("dd/MM/yyyy")))
    return F.when(iso, F.try_to_timestamp(v, F.lit("yyyy-MM-dd"))).when(slash, slashed).otherwise(F.try_to_timestamp(v, F.lit("dd.MM.yyyy"))).cast("date")


def _day_first(v: Column) -> Column:
    """Whether a slashed date is one only with its day, above 12, first."""
    return v.contains("/") & F.try_to_timestamp(v, F.lit("MM/dd/yyyy")).isNull()


def _day_first_image(v: Column, key: str, back: bool = False) -> Column:
    """The image among the dates whose day is above 12: 221 of each year, and the 49 leap days apart."""
    day, month, year = (F.substring(v, a, n).cast("long") for a, n in ((1, 2), (4, 2), (7, 4)))
    before = lambda m: reduce(lambda out, k: out.when(m == k + 1, F.lit(BEFORE_MONTH[k])), range(1, 12), F.when(m == 1, F.lit(BEFORE_MONTH[0])))
    some = radix((year - 1900) * 221 + before(month) + day - 13, (200, 221), key, "day first", back)
    leap = radix(F.floor((year - 1904) / 4).cast("long"), (7, 7), key, "leap day", back)

    def text(x: Column) -> Column:
        at = x % 221
        m = reduce(lambda out, k: out + (at >= BEFORE_MONTH[k]).cast("int"), range(1, 12), F.lit(1))
        return F.concat_ws("/", F.lpad((at - before(m) + 13).cast("string"), 2, "0"), F.lpad(m.cast("string"), 2, "0"), (F.floor(x / F.lit(221)) + 1900).cast("string"))

    usual = F.transform(F.array(some), text)[0]
    return F.when((month == 2) & (day == 29), F.concat(F.lit("29/02/"), (leap * 4 + 1904).cast("string"))).otherwise(usual)


def _phone_image(v: Column, key: str, back: bool = False) -> Column:
    """The country code stays (three digits where nothing parts it off); of each group of digits the first one stays among 2 to 9 or among 0 and 1, as numbering plans ask."""
    code = F.regexp_extract(v, r"^\+(?:1|[0-9]{1,3}(?=[^0-9])|[0-9]{3})", 0)
    groups = F.regexp_extract_all(F.substring(v, F.length(code) + 1, F.length(v)), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    marked = F.array_join(F.transform(groups, lambda g: F.concat(F.translate(F.substring(g, 1, 1), "0123456789", LEADING), F.substring(g, F.lit(2), F.length(g)))), "")
    return F.concat(code, F.translate(characters(marked, key, "phone", back), LEADING, "0123456789"))


def digest(v: Column, key: str) -> Column:
    """HMAC-SHA-256 of a value, so that only who has the key can try values."""
    block = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    block = block.ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(x ^ 0x36 for x in block)), v.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(x ^ 0x5C for x in block)), F.unhex(inner)), 256)


def kind_of(v: Column) -> Column:
    """The kind of a match, if it is valid; null else."""
    d = _digits(v)
    whole = lambda k: F.regexp(v, F.lit(f"^(?:{PATTERNS[k]})$"))
    ssn = (F.substring(v, 1, 3).between("001", "899")) & (F.substring(v, 1, 3) != "666") & (F.substring(v, 5, 2) != "00") & (F.substring(v, 8, 4) != "0000")
    checks = {
        "email": F.lit(True),
        "iban": mod97(F.concat(F.substring(_bare(v), 5, 34), F.substring(_bare(v), 1, 4))) == 1,
        "date": _day(v).isNotNull(),
        "ssn": ssn,
        "ip": reduce(lambda a, b: a & b, [o <= 255 for o in _octets(v)]),
        "card": luhn_sum(d, 1) % 10 == 0,
        "phone": F.length(d).between(8, 15) & ~whole("ssn") & (v.startswith("+") | (F.length(d) == 10)),
    }
    return reduce(lambda out, k: out.when(whole(k) & checks[k], F.lit(k)), KINDS[1:], F.when(whole("email"), F.lit("email")))


def pseudonym(v: Column, kind: Column, key: str = KEY, back: bool = False) -> Column:
    """The image of a valid match of a kind; back gives the match of an image, if account numbers had the usual check digits (02 to 98)."""
    day = F.date_add(F.lit(EPOCH).cast("date"), radix(F.datediff(_day(v), F.lit(EPOCH).cast("date")).cast("long"), DATE_RADIX, key, "date", back).cast("int"))
    date = F.when(v.contains("-"), F.date_format(day, "yyyy-MM-dd")).when(v.contains("/"), F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy"))
    date = F.when(_day_first(v), _day_first_image(v, key, back)).otherwise(date)
    area, group, serial = F.substring(v, 1, 3).cast("long"), F.substring(v, 5, 2).cast("long"), F.substring(v, 8, 4).cast("long")
    index = (F.when(area > 666, area - 2).otherwise(area - 1)) * SSN_RADIX[1] + (group - 1) * 9999 + serial - 1

    def ssn_text(x: Column) -> Column:
        a = F.floor(x / F.lit(SSN_RADIX[1])).cast("long")
        rest = x % SSN_RADIX[1]
        a = F.when(a >= 665, a + 2).otherwise(a + 1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(rest / 9999) + 1).cast("string"), 2, "0"), F.lpad((rest % 9999 + 1).cast("string"), 4, "0"))

    o = [x.cast("long") for x in _octets(v)]
    address = radix(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], IP_RADIX, key, "ip", back)

    def ip_text(x: Column) -> Column:
        return F.concat_ws(".", *[F.pmod(F.shiftright(x, 24 - 8 * k), F.lit(256)).cast("string") for k in range(4)])

    once = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  binds a value to a name, so that it is computed once
    body = F.concat(F.substring(v, 1, 1), characters(F.substring(v, F.lit(2), F.length(v) - 2), key, "card", back))
    card = once(body, lambda b: F.concat(b, ((10 - luhn_sum(_digits(b), 2) % 10) % 10).cast("string")))
    account = characters(F.substring(v, 5, 60), key, "iban", back)
    iban = once(account, lambda b: F.concat(F.substring(v, 1, 2), F.lpad((98 - mod97(F.concat(_bare(b), F.substring(v, 1, 2), F.lit("00")))).cast("string"), 2, "0"), b))
    local = F.substring_index(v, "@", 1)
    email = F.concat(characters(local, key, "email", back), F.lit("@"), F.substring_index(v, "@", -1))
    phone = _phone_image(v, key, back)
    return (
        F.when(kind == "email", email).when(kind == "iban", iban).when(kind == "date", date).when(kind == "ssn", once(radix(index, SSN_RADIX, key, "ssn", back), ssn_text))
        .when(kind == "ip", once(address, ip_text)).when(kind == "card", card).when(kind == "phone", phone)
    )


def original(v: Column, key: str = KEY) -> Column:
    """What stood in a text before its pseudonym v, for who has the key; null where v is no valid value."""
    return pseudonym(v, kind_of(v), key, back=True)


def _marked(start: Column) -> Column:
    """The escaped text with marks, so that all its matches of MARKED are valid. Matches that a failed one may reach into wait for it."""

    def step(s: Column, _: Column) -> Column:
        pieces = F.transform(F.regexp_extract_all(s["t"], F.lit(MARKED), F.lit(0)), lambda v: F.struct(v.alias("v"), kind_of(v).isNull().alias("bad")))
        held = F.zip_with(F.split(s["t"], MARKED, -1), pieces, lambda a, b: F.struct(a.alias("a"), b["v"].alias("v"), b["bad"].alias("bad")))

        def mark(o: Column, x: Column) -> Column:
            free = ~(o["bad"] & F.regexp(x["a"], F.lit(rf"^[0-9A-Z\x20./()+{MARK}-]*$")))
            return F.struct(F.concat(o["out"], F.array(F.concat(x["a"], F.when(x["bad"] & free, MARK).otherwise(""), F.coalesce(x["v"], F.lit(""))))).alias("out"), F.coalesce(x["bad"], F.lit(False)).alias("bad"))

        marked = F.aggregate(held, F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("bad")), mark, lambda o: F.array_join(o["out"], ""))
        return F.when(s["open"], F.transform(F.array(marked), lambda t: F.struct(t.alias("t"), (t != s["t"]).alias("open")))[0]).otherwise(s)

    steps = F.sequence(F.lit(1), 6 * F.size(F.split(start, "[^A-Za-z0-9]+")) + 1)
    return F.aggregate(steps, F.struct(start.alias("t"), F.lit(True).alias("open")), step, lambda s: s["t"])


def _settled(text: Column, window: int = WINDOW) -> Column:
    """The text with marks, window by window, so that a long text takes time in proportion to its length.

    What a window's last REACH characters hold may go on beyond it, so the window is cut before them, at its last space
    that no match holds: no pattern looks back over a space, so what follows is matched as if it began there. A window
    without such a space is tried again at twice the size.
    """
    start = reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), ESCAPE, text)

    def step(s: Column, _: Column) -> Column:
        whole = F.length(s["rest"]) <= s["size"]

        def cut(t: Column) -> Column:
            # matches as characters that are no spaces, so that places stay
            hidden = F.array_join(F.zip_with(F.split(t, MARKED, -1), F.regexp_extract_all(t, F.lit(MARKED), F.lit(0)), lambda a, v: F.concat(a, F.repeat(F.lit("x"), F.coalesce(F.length(v), F.lit(0))))), "")
            sure = F.greatest(F.length(t) - REACH, F.lit(0))
            back = F.instr(F.reverse(F.substring(hidden, F.lit(1), sure)), " ")
            at = F.when(whole, F.length(t)).when(back > 0, sure - back + 1).otherwise(0)
            return F.transform(F.array(at), lambda n: moved(t, n))[0]

        def moved(t: Column, n: Column) -> Column:
            head = F.substring(t, F.lit(1), n)
            rest = F.substring(s["rest"], F.length(F.replace(head, F.lit(MARK), F.lit(""))) + 1, F.length(s["rest"]))
            return F.struct(F.concat(s["done"], head).alias("done"), rest.alias("rest"), F.when(n > 0, window).otherwise(2 * s["size"]).cast("int").alias("size"))

        read = F.transform(F.array(F.substring(s["rest"], F.lit(1), s["size"])), lambda head: _marked(head))
        return F.when(s["rest"] == "", s).otherwise(F.transform(read, cut)[0])

    steps = F.sequence(F.lit(1), F.size(F.split(start, " ")) + 32)
    return F.aggregate(steps, F.struct(F.lit("").alias("done"), start.alias("rest"), F.lit(window).cast("int").alias("size")), step, lambda s: F.concat(s["done"], s["rest"]))


def _plain(text: Column) -> Column:
    """What stood in the text before it was marked."""
    return reduce(lambda t, x: F.replace(t, F.lit(x[1]), F.lit(x[0])), reversed(ESCAPE), F.replace(text, F.lit(MARK), F.lit("")))


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """All columns, the text with pseudonyms, and `pii`: array<struct<kind, value, pseudonym>> in the order of the text.

    `value` is a keyed digest of what stood there, not the value. The default key is for tests: give your own. Null texts stay null with an empty array, empty ones empty.
    Invalid matches stay as they are and are not listed, but for valid values inside them. Repeated rows change alike. A column named pii is replaced; all others come back, whatever their names. Very long texts are read window by window; an empty table gives no rows.
    """
    text = F.col("text")
    some = F.coalesce(F.regexp(text, F.lit("[0-9]|@")), F.lit(False))
    found = F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found_, bad_, marked_, kinds_, images_, text_ = fresh(docs, "found", "bad", "marked", "kinds", "images", "text")
    rows = docs.withColumn(found_, found)
    rows = rows.withColumn(bad_, F.when(F.size(found_) > 0, F.exists(found_, lambda v: kind_of(v).isNull())).otherwise(False))
    rows = rows.withColumn(marked_, F.when(F.col(bad_), _settled(text)))
    rows = rows.withColumn(found_, F.when(F.col(bad_), F.regexp_extract_all(marked_, F.lit(MARKED), F.lit(0))).otherwise(F.col(found_)))

    def one(v: Column) -> Column:
        return F.struct(v.alias("v"), kind_of(v).alias("kind"))

    rows = rows.withColumn(kinds_, F.when(F.size(found_) > 0, F.transform(found_, one)).otherwise(F.array().cast("array<struct<v:string,kind:string>>")))
    image = lambda x: F.struct(x["kind"].alias("kind"), x["v"].alias("v"), F.coalesce(pseudonym(x["v"], x["kind"], key), x["v"]).alias("w"))
    rows = rows.withColumn(images_, F.when(F.size(kinds_) > 0, F.transform(kinds_, image)).otherwise(F.array().cast("array<struct<kind:string,v:string,w:string>>")))
    between = F.when(F.col(bad_), F.transform(F.split(marked_, MARKED, -1), _plain)).otherwise(F.split(text, ANY, -1))
    joined = F.array_join(F.zip_with(between, F.col(images_), lambda a, b: F.concat(a, F.coalesce(b["w"], F.lit("")))), "")
    listed = F.transform(F.filter(images_, lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), digest(x["v"], key).alias("value"), x["w"].alias("pseudonym")))
    rows = rows.withColumn(text_, F.when(F.size(images_) > 0, joined).otherwise(text)).withColumn("pii", listed)
    return rows.select(*[F.col(text_).alias("text") if c == "text" else F.col(c) for c in docs.columns if c != "pii"], "pii")


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), *counts)
