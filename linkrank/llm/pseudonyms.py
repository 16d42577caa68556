"""Format-preserving pseudonyms by keyed Feistel permutations, in DataFrame functions alone.

One pattern finds candidates; each is validated (check digits, ranges, calendar). A validated value is replaced by its
image under a keyed permutation of all values of its format, so equal values get equal pseudonyms in every document,
different ones stay different, and the result is valid itself. What does not validate stays as it is.

Formats: payment card numbers (prefix and length of a network, Luhn; the first four digits stay, the check digit is made anew), IBANs (mod 97; country and
letters stay, digits are permuted, check digits are made anew), telephone numbers (national digits are permuted,
punctuation stays; without a country code, area and exchange start with 2 to 9 before and after), US social security numbers, IPv4 addresses, dates (ISO, dotted, slashed; permuted within their
century, with the widths of day and month as written), e-mail addresses (all but the top-level domain; letters to letters, digits to digits), and secrets (long
hexadecimal strings, and values given to a name such as token or password).

A permutation is a Feistel network of ``ROUNDS`` rounds: the value is split in two halves, and each round shifts one
half by SHA-256 of (key, format, round, other half), so it can be undone with the key. Character strings are shifted
letter by letter in their own class; addresses, numbers of other ranges and dates by modular addition on the two halves.
A permutation of more values than the format has, such as 31 days for each month, is applied until a valid one comes (``WALK``).

Results for odd input: a null text stays null, a text without candidates stays as it is; overlapping candidates are
taken from the left. Very long texts are treated whole, in time that grows with their length. Rows and all other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Most steps until a permuted value is valid; each misses with a chance of 3 % at most, so all of them with 1e-48.
WALK = 32

# Patterns of the candidates.
#: A local part has 64 characters at most, a label 63, a name 127 labels. It starts where letters or digits start, so long runs are tried once.
EMAIL = r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+'-]{0,63}+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,24}"
#: Not the number of a version.
IPV4 = r"(?<![\w.])(?<!(?i:version|release|build|ver|v)[. ]{0,2})\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
#: Characters of an IBAN by country, so that what follows one is not taken for its last group.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_known = "|".join(f"(?:{of.replace(' ', '|')})\\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, of in IBAN_LENGTHS.items())
#: The countries' own lengths first; other codes, and other lengths, as far as the groups go.
IBAN = rf"(?<!\w)(?:(?:{_known})(?!\w)|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,4}})?(?!\w))"
DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\w/-]|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
CARD = r"(?<![\w-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])"
#: Prefixes and lengths of the card networks; none depends on more than four digits.
NETWORKS = (
    r"^(?:4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11,16}"
    r"|35(?:2[89]|[3-8]\d)\d{12,15}|6(?:011|4[4-9]\d|5\d\d)\d{12,15}|62\d{14,17}|(?:5018|5020|5038|5893|6304|6759|676[1-3])\d{8,15})$"
)
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?![\w-])|(?<![\w+])(?:1[ .-])?(?:\([2-9]\d{2}\) ?[2-9]\d{2}[ .-]\d{4}|[2-9]\d{2}-[2-9]\d{2}-\d{4}|[2-9]\d{2}\.[2-9]\d{2}\.\d{4}|[2-9]\d{2} [2-9]\d{2} \d{4})(?![\w-])"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])|(?<=(?i:token|secret|passwd|password|apikey|api_key|api-key|access_key)[\"']?\s{0,4}[=:]\s{0,4}[\"']?)[A-Za-z0-9_+/-]{12,}+(?![A-Za-z0-9_+/-])"
CANDIDATES = "|".join((EMAIL, SECRET, IBAN, IPV4, DATE, SSN, CARD, PHONE))

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _each(text: Column) -> Column:
    """The characters of a text."""
    return F.when(F.char_length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def _prf(key: str, kind: str, turn: Column, half: Column) -> Column:
    """SHA-256, in hexadecimal, of key, format, round and half."""
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), turn.cast("string"), F.lit("|"), half, F.lit(f"|{key}")).cast("binary"), 256)


def _number(hexadecimal: Column, at: Column, digits: int) -> Column:
    return F.conv(F.substr(hexadecimal, at, F.lit(digits)), 16, 10).cast("long")


def _shift(half: Column, pad: Column, letters: int) -> Column:
    """Shift each character in its class by three hexadecimal digits of ``pad``; other characters stay."""

    def one(pad: Column, c: Column, i: Column) -> Column:
        by = _number(pad, (i % 21) * 3 + 1, 3).cast("int")
        out = c
        for alphabet in (LOWER[:letters], UPPER[:letters], DIGITS):
            place = F.instr(F.lit(alphabet), c)
            out = F.when(place > 0, F.substr(F.lit(alphabet), (place - 1 + by) % len(alphabet) + 1, F.lit(1))).otherwise(out)
        return out

    # bound first: the pad is hashed once for the half, not for each character
    return F.element_at(F.transform(F.array(pad), lambda p: F.array_join(F.transform(_each(half), lambda c, i: one(p, c, i)), "")), 1)


def permute_characters(text: Column, key: str, kind: str, letters: int = 26) -> Column:
    """Permutation of the strings of one shape: digits to digits, small to small, capital to capital letters."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1).alias("b"))

    def turn(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, _shift(acc["a"], _prf(key, kind, r, acc["b"]), letters)).otherwise(acc["a"]).alias("a"),
            F.when(even, acc["b"]).otherwise(_shift(acc["b"], _prf(key, kind, r, acc["a"]), letters)).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: F.concat(acc["a"], acc["b"]))


def permute_number(value: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """Permutation of 0 .. a * b - 1."""
    start = F.struct(F.floor(value / b).cast("long").alias("a"), (value % b).cast("long").alias("b"))

    def turn(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        by = _number(_prf(key, kind, r, F.when(even, acc["b"]).otherwise(acc["a"]).cast("string")), F.lit(1), 12)
        return F.struct(F.when(even, (acc["a"] + by) % a).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise((acc["b"] + by) % b).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: acc["a"] * b + acc["b"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits``, from the left."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def one(acc: Column, c: Column) -> Column:
        digit = F.instr(F.lit(DIGITS), c) > 0
        return F.struct(F.concat(acc["out"], F.when(digit, F.substr(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + digit.cast("int")).alias("at"))

    return F.aggregate(_each(shape), start, one, lambda acc: acc["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum whose last digit counts once."""
    n = F.char_length(digits)
    return F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 0, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(F.substr(digits, i, F.lit(1)).cast("int") * 2 - F.when(F.substr(digits, i, F.lit(1)).cast("int") > 4, F.lit(9)).otherwise(F.lit(0))),
    )


def mod97(text: Column) -> Column:
    """Remainder by 97 of a string of digits and capital letters (A = 10 to Z = 35)."""

    def one(acc: Column, c: Column) -> Column:
        letter = F.instr(F.lit(UPPER), c)
        return F.when(letter > 0, (acc * 100 + letter + 9) % 97).otherwise((acc * 10 + c.cast("int")) % 97)

    return F.aggregate(_each(text), F.lit(0), one)


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    n = F.char_length(d)
    body = F.concat(F.substr(d, F.lit(1), F.lit(4)), permute_characters(F.substr(d, F.lit(5), n - 5), key, "card"))
    return F.element_at(F.transform(F.array(body), lambda b: _refill(m, F.concat(b, ((F.lit(10) - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))), 1)


def _iban(m: Column, key: str) -> Column:
    bare = F.replace(m, F.lit(" "), F.lit(""))
    account = F.substr(bare, F.lit(5))
    moved = F.element_at(F.transform(F.array(permute_characters(_digits(account), key, "iban")), lambda d: _refill(account, d)), 1)
    check = lambda x: F.lpad((F.lit(98) - mod97(F.concat(x, F.substr(bare, F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), 2, "0")
    # check digits and account digits in order refill the match, whose letters stay
    return F.element_at(F.transform(F.array(moved), lambda x: _refill(m, F.concat(check(x), _digits(x)))), 1)


def _iban_ok(m: Column) -> Column:
    bare = F.replace(m, F.lit(" "), F.lit(""))
    return F.char_length(bare).between(15, 34) & (mod97(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))) == 1)


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    # the country code after + stays: for +1, one digit; otherwise what leaves ten digits, or one digit
    code = F.when(F.char_length(d) > 10, F.char_length(d) - 10).otherwise(F.lit(1))
    abroad = _refill(m, F.concat(F.substr(d, F.lit(1), code), permute_characters(F.substr(d, code + 1), key, "phone")))
    # area and exchange from 200 to 999 and a line of four digits are counted through: 80,000 x 80,000 values
    own = F.substr(d, F.char_length(d) - 9)
    part = lambda x, at, n: F.substr(x, F.lit(at), F.lit(n)).cast("long")
    value = ((part(own, 1, 3) - 200) * 800 + part(own, 4, 3) - 200) * 10000 + part(own, 7, 4)
    moved = F.array(permute_number(value, F.lit(80000), F.lit(80000), key, "phone"))
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    lead = F.substr(d, F.lit(1), F.char_length(d) - 10)
    written = lambda v: _refill(m, F.concat(lead, pad(F.floor(v / 8000000) + 200, 3), pad(F.floor(v / 10000) % 800 + 200, 3), pad(v % 10000, 4)))
    return F.when(F.startswith(m, F.lit("+")), abroad).otherwise(F.element_at(F.transform(moved, written), 1))


def _ssn_ok(m: Column) -> Column:
    area = F.substr(m, F.lit(1), F.lit(3)).cast("int")
    return area.between(1, 899) & (area != 666) & (F.substr(m, F.lit(5), F.lit(2)) != "00") & (F.substr(m, F.lit(8)) != "0000")


def _ssn(m: Column, key: str) -> Column:
    """Numbers of valid areas (1 to 899 but 666), groups and serials are counted through and permuted."""
    area, rest = F.substr(m, F.lit(1), F.lit(3)).cast("long"), 99 * 9999
    value = (area - F.when(area > 666, F.lit(2)).otherwise(F.lit(1))) * rest + (F.substr(m, F.lit(5), F.lit(2)).cast("long") - 1) * 9999 + F.substr(m, F.lit(8)).cast("long") - 1
    moved = F.array(permute_number(value, F.lit(898), F.lit(rest), key, "ssn"))

    def written(v: Column) -> Column:
        of = F.floor(v / rest) + 1
        of = F.when(of >= 666, of + 1).otherwise(of)
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat(pad(of, 3), F.lit("-"), pad(F.floor((v % rest) / 9999) + 1, 2), F.lit("-"), pad(v % 9999 + 1, 4))

    return F.element_at(F.transform(moved, written), 1)


def _octet(m: Column, i: int) -> Column:
    return F.element_at(F.split(m, "[.]"), i).cast("long")


def _ipv4(m: Column, key: str) -> Column:
    value = ((_octet(m, 1) * 256 + _octet(m, 2)) * 256 + _octet(m, 3)) * 256 + _octet(m, 4)
    moved = F.array(permute_number(value, F.lit(65536), F.lit(65536), key, "ipv4"))
    part = lambda v, of: (F.floor(v / of) % 256).cast("string")
    return F.element_at(F.transform(moved, lambda v: F.concat_ws(".", part(v, 16777216), part(v, 65536), part(v, 256), part(v, 1))), 1)


def _date_fields(m: Column) -> dict[str, Column]:
    """Year, month and day of a written date, the widths of the last two, and whether the day comes first.

    Year first; with dots, day first; with slashes, month first unless it exceeds 12.
    """
    parts = F.split(m, "[./-]")
    first, second, third = (F.element_at(parts, i) for i in (1, 2, 3))
    iso = F.instr(m, "-") > 0
    over = ~iso & (F.instr(m, ".") == 0) & (first.cast("int") > 12)
    day_first = (F.instr(m, ".") > 0) | over
    month, day = F.when(iso | day_first, second).otherwise(first), F.when(iso, third).when(day_first, first).otherwise(second)
    return {"year": F.when(iso, first).otherwise(third).cast("int"), "month": month.cast("int"), "day": day.cast("int"), "mw": F.char_length(month), "dw": F.char_length(day), "over": over, "day_first": day_first, "iso": iso}


def _days_of(year: Column, month: Column) -> Column:
    """Days of a month, or null for no month."""
    return F.dayofmonth(F.last_day(F.when(month.between(1, 12), F.make_date(year.cast("int"), month.cast("int"), F.lit(1)))))


def _date_ok(m: Column) -> Column:
    f = _date_fields(m)
    return F.coalesce(f["year"].between(1000, 2999) & f["day"].between(1, _days_of(f["year"], f["month"])), F.lit(False))


def _date(m: Column, key: str) -> Column:
    """Year of the century, month and day are permuted. A field of one digit has 1 to 9, one of two digits all values; a day
    that is known by being over 12 has 13 to 31."""
    f = _date_fields(m)
    months, least = F.when(f["mw"] == 1, F.lit(9)).otherwise(F.lit(12)), F.when(f["over"], F.lit(13)).otherwise(F.lit(1))
    days = F.when(f["dw"] == 1, F.lit(9)).otherwise(F.lit(32) - least)
    century = F.floor(f["year"] / 100).cast("long") * 100
    start = ((f["year"] - century) * months + f["month"] - 1) * days + f["day"] - least
    given = F.struct(start.cast("long").alias("v"), F.lit(False).alias("done"), (months * days).cast("long").alias("b"), months.cast("long").alias("months"), days.cast("long").alias("days"), least.cast("long").alias("least"), century.alias("century"))

    def step(acc: Column, _: Column) -> Column:
        moved = F.element_at(F.transform(F.array(permute_number(acc["v"], F.lit(100).cast("long"), acc["b"], key, "date")), lambda v: _walked(acc, v)), 1)
        return F.when(acc["done"], acc).otherwise(moved)

    def _walked(acc: Column, v: Column) -> Column:
        year, month, day = acc["century"] + F.floor(v / acc["b"]), F.floor((v % acc["b"]) / acc["days"]) + 1, v % acc["days"] + acc["least"]
        return F.struct(v.alias("v"), (day <= _days_of(year, month)).alias("done"), *(acc[c].alias(c) for c in ("b", "months", "days", "least", "century")))

    def written(acc: Column) -> Column:
        v = acc["v"]
        year, month, day = (acc["century"] + F.floor(v / acc["b"])).cast("string"), F.floor((v % acc["b"]) / acc["days"]) + 1, v % acc["days"] + acc["least"]
        month, day = (F.when(width == 1, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0")) for x, width in ((month, f["mw"]), (day, f["dw"])))
        return F.when(f["iso"], F.concat_ws("-", year, month, day)).when(F.instr(m, ".") > 0, F.concat_ws(".", day, month, year)).when(f["day_first"], F.concat_ws("/", day, month, year)).otherwise(F.concat_ws("/", month, day, year))

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), given, step, written)


def _email(m: Column, key: str) -> Column:
    """All but the top-level domain moves."""
    tail = F.regexp_extract(m, r"\.[A-Za-z]{2,24}$", 0)
    return F.concat(permute_characters(F.substr(m, F.lit(1), F.char_length(m) - F.char_length(tail)), key, "email"), tail)


def _secret(m: Column, key: str) -> Column:
    hexadecimal = m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    return F.when(hexadecimal, permute_characters(m, key, "hex", 6)).otherwise(permute_characters(m, key, "secret"))


def kind_of(m: Column) -> Column:
    """The validated format of a candidate, or null."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    d = _digits(m)
    octets = F.forall(F.split(m, "[.]"), lambda o: (o.cast("int") <= 255) & ~o.rlike("^0[0-9]"))
    return (
        F.when(F.instr(m, "@") > 0, F.lit("email"))
        .when(whole(IPV4), F.when(octets, F.lit("ipv4")))
        .when(whole(DATE), F.when(_date_ok(m), F.lit("date")))
        .when(whole(SSN), F.when(_ssn_ok(m), F.lit("ssn")))
        .when(whole(CARD), F.when(d.rlike(NETWORKS) & (luhn_sum(d) % 10 == 0), F.lit("card")))
        .when(whole(IBAN) & _iban_ok(m), F.lit("iban"))
        .when(whole(PHONE), F.when(F.char_length(d).between(8, 15), F.lit("phone")))
        .when(m.rlike("[0-9]") & m.rlike("[A-Za-z]") & m.rlike("^[A-Za-z0-9_+/-]{12,}$"), F.lit("secret"))
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    made = {"email": _email, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "card": _card, "iban": _iban, "phone": _phone, "secret": _secret}
    out = F.when(kind.isNull(), m)
    for name, make in made.items():
        out = out.when(kind == name, make(m, key))
    return out.otherwise(m)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in its text column; ``found`` names a column for the number of replaced values."""
    names = docs.columns
    column = F.col(text).cast("string")
    some = column.rlike("[0-9@]")
    step = docs.withColumn("__pii_m", F.when(some, F.regexp_extract_all(column, F.lit(f"({CANDIDATES.replace(chr(92) + '1', chr(92) + '2')})"), F.lit(0))))
    step = step.withColumn("__pii_m", F.when(F.size("__pii_m") > 0, F.col("__pii_m")))
    step = step.withColumn("__pii_k", F.transform("__pii_m", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"))))
    step = step.withColumn("__pii_r", F.transform("__pii_k", lambda x: pseudonym(x["m"], x["kind"], key)))
    pieces = F.split(column, f"({CANDIDATES.replace(chr(92) + '1', chr(92) + '2')})", -1)
    step = step.withColumn("__pii_p", F.when(F.col("__pii_m").isNotNull(), pieces))
    joined = F.array_join(F.zip_with("__pii_p", F.concat("__pii_r", F.array(F.lit(""))), lambda p, r: F.concat(p, r)), "")
    out = [F.coalesce(joined, column).alias(c) if c == text else F.col(c) for c in names]
    if found is not None:
        out.append(F.coalesce(F.size(F.filter("__pii_k", lambda x: x["kind"].isNotNull())), F.lit(0)).cast("long").alias(found))
    return step.select(*out)
