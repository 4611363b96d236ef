"""Format-preserving Feistel pseudonyms for personal data, with DataFrame functions only.

One pattern finds the values; each is validated (Luhn sum, mod-97 sum, octets, calendar, number ranges) and replaced by a
keyed permutation of all values of its format.  The permutation is an unbalanced Feistel network over the exact domain: two
residues ``a < m1`` and ``b < m2`` in turn add a keyed digest of the other, so every result is valid and no two values
share one.  The key alone decides, so equal values get equal pseudonyms in all documents, and whoever has the key can invert them.

* card numbers: all digits but the last, then the Luhn digit;   * phone numbers: the last ten digits (all but two of 8 to 10 after a +);
* IP addresses: two halves of 16 bits;                           * social security numbers: area x (group, serial);
* IBANs: the digits after the check digits, then the check;      * dates: days of 1900-01-01 .. 2099-11-13;
* e-mail addresses: letters and digits of the local part, each within its class.

Values that fail validation (a 16-digit number without a Luhn sum, an octet of 300, a 31st of June) are left alone, as is all other text.
Not taken for personal data: slash dates that are no MM/dd/yyyy, ten digits without a separator, and national phone numbers in other groups than 3-3-4.

Each row is rewritten on its own: no shuffle, no state, no key skew.  Defined cases: null text counts as empty; texts of any length
are read whole; repeated rows and equal values get equal results; an empty table gives an empty result; other columns pass through, and a
column that has the name of the output of kinds is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.llm.registry import register, table

KEY = "starlens-demo-key"  # callers pass their own secret
ROUNDS = 5  # double rounds
FIRST_DAY, DAYS = "1900-01-01", (250, 292)  # 73,000 days

# The formats.
_B, _A = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
PHONE = rf"(?:(?<![\p{{L}}\p{{N}}_+])\+?[0-9]{{1,3}}[ .-]?|(?<![\p{{L}}\p{{N}}_]))\([0-9]{{3}}\)[ .-]?[0-9]{{3}}[ .-][0-9]{{4}}{_A}|(?<![\p{{L}}\p{{N}}_.-])(?:\+?[0-9]{{1,3}}[ .-])?[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}}(?![\p{{L}}\p{{N}}_]|[.-][0-9])"
IP = r"(?<![\p{L}\p{N}_]|[0-9]\.)(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}_]|\.[0-9])"
DATE = rf"{_B}(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}|[0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{4}}){_A}"
SSN = rf"{_B}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_A}"
IBAN = rf"{_B}[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}{_A}"
# lengths of IBANs by country: in groups of four only they tell where one ends
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_GROUPS = (
    rf"{_B}(?:"
    + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
    + f"){_A}"
)
ABROAD = r"(?<![\p{L}\p{N}_+])\+[1-9](?:\)?[ .-]?\(?[0-9]){6,13}[0-9](?![\p{L}\p{N}_]|[.-][0-9])"  # 8 to 15 digits in any groups
CARD = rf"{_B}(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}){_A}"
# A look at the next characters spares most positions the alternatives; e-mail addresses are sought where there is an @.
NUMBERS = r"(?=[0-9(+]|[A-Z]{2}[0-9]{2})(?:" + "|".join((CARD, PHONE, IP, DATE, SSN, IBAN, IBAN_GROUPS, ABROAD)) + ")"
PATTERN = f"{EMAIL}|{NUMBERS}"
KINDS = ("card", "phone", "email", "ip", "date", "ssn", "iban")


def _digest(key: str, kind: str, i: Column, v: Column) -> Column:
    """60 keyed bits."""
    hashed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), v.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, m1: Column | int, m2: Column | int, key: str, kind: str) -> Column:
    """Keyed permutation of the pairs (a, b) with a < m1, b < m2; a struct of both."""
    m1, m2 = (m.cast("long") if isinstance(m, Column) else F.lit(m).cast("long") for m in (m1, m2))

    def step(s, i):
        a2 = F.pmod(s["a"] + _digest(key, kind, i * 2, s["b"]), m1)
        return F.struct(a2.alias("a"), F.pmod(s["b"] + _digest(key, kind, i * 2 + 1, a2), m2).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sub(s: Column, start, length=None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substr(s, lit(start), lit(length)) if length is not None else F.substr(s, lit(start))


def permute_digits(d: Column, key: str, kind: str) -> Column:
    """A string of 2 to 36 digits to another of the same length."""
    half = F.floor(F.length(d) / 2).cast("int")
    rest = F.length(d) - half
    power = lambda n: F.pow(F.lit(10.0), n).cast("long")
    out = feistel(_sub(d, 1, half), _sub(d, half + 1), power(half), power(rest), key, kind)
    return _once(out, lambda s: F.concat(F.lpad(s["a"].cast("string"), half, F.lit("0")), F.lpad(s["b"].cast("string"), rest, F.lit("0"))))


def luhn_sum(d: Column, doubled: int) -> Column:
    """Luhn sum; the last digit counts double where ``doubled`` is 1."""

    def digit(acc, i):
        x = _sub(d, -i, 1).cast("int")
        twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return acc + F.when(F.pmod(i, F.lit(2)) == doubled, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), digit)


def _card(d: Column, key: str) -> Column:
    valid = (F.length(d).between(13, 19)) & (F.pmod(luhn_sum(d, 0), F.lit(10)) == 0)
    new = _once(permute_digits(_sub(d, 1, F.length(d) - 1), key, "card"), lambda p: F.concat(p, F.pmod(-luhn_sum(p, 1), F.lit(10)).cast("string")))
    return F.when(valid, new)


def _phone(m: Column, d: Column, key: str) -> Column:
    n = F.length(d)
    lead = F.when(F.startswith(m, F.lit("+")) & (n <= 10), 2).otherwise(n - 10)  # the shortest international numbers keep two digits
    return F.when(lead >= 0, F.concat(_sub(d, 1, lead), permute_digits(_sub(d, lead + 1), key, "phone")))


def _ip(m: Column, key: str) -> Column:
    def build(o):
        valid = F.forall(o, lambda x: x <= 255)
        out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 1 << 16, 1 << 16, key, "ip")
        part = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
        return F.when(valid, _once(out, lambda s: F.concat_ws(".", part(s["a"]), part(s["b"]))))

    return _once(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), build)


def _date(m: Column, form: str, key: str) -> Column:
    def build(day):
        out = feistel(F.floor(day / DAYS[1]), F.pmod(day, F.lit(DAYS[1])), *DAYS, key, "date")
        moved = _once(out, lambda s: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * DAYS[1] + s["b"]).cast("int")), form))
        return F.when((day >= 0) & (day < DAYS[0] * DAYS[1]), moved)

    return _once(F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date")), build)


def _ssn(d: Column, key: str) -> Column:
    area, group, serial = _sub(d, 1, 3).cast("int"), _sub(d, 4, 2).cast("int"), _sub(d, 6, 4).cast("int")
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas
    out = feistel(place, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")

    def build(s):
        a = F.when(s["a"] >= 665, s["a"] + 2).otherwise(s["a"] + 1)
        return F.concat(F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(s["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["b"] % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, _once(out, build))


def mod97(s: Column) -> Column:
    """Remainder of an IBAN rearranged for its check: letters count as 10 .. 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), lambda acc, c: F.pmod(acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))


def _fill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order by those of ``digits``."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")

    def at(c, i):
        before = F.length(F.regexp_replace(_sub(shape, 1, i + 1), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]"), _sub(digits, before, 1)).otherwise(c)

    return F.array_join(F.transform(chars, at), "")


def _iban(m: Column, key: str) -> Column:
    country, body = _sub(m, 1, 2), _sub(m, 5)
    digits = F.regexp_replace(body, "[^0-9]", "")
    valid = (mod97(F.concat(body, _sub(m, 1, 4))) == 1) & (F.length(digits) >= 2)

    def build(new):
        return F.concat(country, F.lpad((F.lit(98) - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0"), new)

    return F.when(valid, _once(_fill(body, permute_digits(digits, key, "iban")), build))


def _grouped_iban(m: Column, key: str) -> Column:
    return _once(_iban(F.regexp_replace(m, " ", ""), key), lambda new: F.when(F.contains(m, F.lit(" ")), F.regexp_replace(new, "(.{4})(?=.)", "$1 ")).otherwise(new))


def _card_in_iban(m: Column, key: str) -> Column:
    """The match with the card number in its second to fifth group replaced, or null: for what looks like an IBAN in groups and is none."""
    card = _sub(m, 6, 19)
    new = _card(F.regexp_replace(card, " ", ""), key)
    return F.when(card.rlike("^[0-9]{4}(?: [0-9]{4}){3}$"), _once(new, lambda x: F.when(x.isNotNull(), F.concat(_sub(m, 1, 5), _fill(card, x), _sub(m, 25)))))


def _email(m: Column, key: str) -> Column:
    """Letters and digits of the local part: two halves shift each other's characters within their classes."""
    at = F.instr(m, "@") - 1
    half = F.floor(at / 2).cast("int")

    def shift(s, i, other):
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), other).cast("binary"), 256)

        def one(c, j):
            place = F.pmod(j, F.lit(16)) * 4 + 1
            by = F.conv(_sub(stream, place, 4), 16, 10).cast("int") + j
            code = F.ascii(c)
            turn = lambda base, n: F.char((F.pmod(code - base + by, F.lit(n)) + base).cast("long"))
            return F.when(c.rlike("[a-z]"), turn(97, 26)).when(c.rlike("[A-Z]"), turn(65, 26)).when(c.rlike("[0-9]"), turn(48, 10)).otherwise(c)

        return F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), one), "")

    def step(s, i):
        a2 = shift(s["a"], i * 2, s["b"])
        return F.struct(a2.alias("a"), shift(s["b"], i * 2 + 1, a2).alias("b"))

    out = F.aggregate(F.sequence(F.lit(0), F.lit(2)), F.struct(_sub(m, 1, half).alias("a"), _sub(m, half + 1, at - half).alias("b")), step)
    return _once(out, lambda s: F.concat(s["a"], s["b"], _sub(m, at + 1)))


def pseudonym(m: Column, key: str) -> Column:
    """(kind, value) of a match; both null where it does not hold up."""
    d = F.regexp_replace(m, "[^0-9]", "")
    is_ = lambda p: m.rlike(rf"^(?:{p})$")
    kind = (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(is_(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), "ip")
        .when(is_(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}"), "date")
        .when(is_(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), "ssn")
        .when(is_(r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]+"), "iban")
        .when(is_(r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"), "card")
        .otherwise("phone")
    )
    dated = F.when(F.contains(m, F.lit("-")), _date(m, "yyyy-MM-dd", key)).when(F.contains(m, F.lit("/")), _date(m, "MM/dd/yyyy", key)).otherwise(_date(m, "dd.MM.yyyy", key))
    like = lambda digits: _once(digits, lambda x: F.when(x.isNotNull(), _fill(m, x)))
    return _once(
        kind,
        lambda k: _once(
            F.when(k == "email", _email(m, key)).when(k == "ip", _ip(m, key)).when(k == "date", dated).when(k == "ssn", like(_ssn(d, key)))
            .when(k == "iban", _grouped_iban(m, key)).when(k == "card", like(_card(d, key))).otherwise(like(_phone(m, d, key))),
            lambda v: _once(
                F.when(v.isNull() & (k == "iban"), _card_in_iban(m, key)),
                lambda c: F.struct(F.when(v.isNotNull(), k).when(c.isNotNull(), F.lit("card")).alias("kind"), F.coalesce(v, c, m).alias("value")),
            ),
        ),
    )


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY, out: str = "text", found: str = "private") -> DataFrame:
    """``docs`` with the rewritten text in ``out`` and the kinds of its values, in order, in ``found``.

    A column of ``docs`` that has the name ``found`` already would be lost, so that name is refused.
    """
    if found.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents have a column {found!r}; name another one for the kinds")
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    mail = F.contains(t, F.lit("@"))
    numbers = t.rlike(NUMBERS)
    matches = F.when(mail, F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))).when(numbers, F.regexp_extract_all(t, F.lit(NUMBERS), F.lit(0)))
    d = docs.withColumn(found, F.transform(matches, lambda m: pseudonym(m, key)))
    kinds = F.coalesce(F.filter(F.transform(F.col(found), lambda v: v["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    gaps = F.when(mail, F.split(t, PATTERN, -1)).otherwise(F.split(t, NUMBERS, -1))
    new = F.array_join(
        F.transform(
            F.arrays_zip(gaps.alias("gap"), F.transform(F.col(found), lambda v: v["value"]).alias("value")),
            lambda p: F.concat(p["gap"], F.coalesce(p["value"], F.lit(""))),
        ),
        "",
    )
    return d.withColumn(out, F.when(F.size(found) > 0, new).otherwise(t)).withColumn(found, kinds)


@register("op5_feistel_pii")
def op5_feistel_pii(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    p = pseudonymise(d)
    count = lambda k: F.size(F.filter("private", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return p.select("doc_id", "text", F.size("private").cast("long").alias("n_private"), *map(count, KINDS))
