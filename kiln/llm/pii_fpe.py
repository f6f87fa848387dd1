"""Format-preserving pseudonyms for personal data (DataFrame functions only).

Numbers and dates are found by pattern, validated (Luhn, mod 97, octets, calendar, area and group
numbers), and replaced by a keyed permutation of the same format: a Feistel network over Z_a x Z_b,
where a * b is the exact size of the format, so every result is in the format, the map is a
bijection, and equal values get equal pseudonyms in all documents. Separators stay in place; card
and IBAN check digits are recomputed. Addresses and secrets have no countable format: an email's
local part and a secret's characters are replaced by keyed hash text of the same alphabet.

A pattern takes what follows a number along (a security code, a year, a word), so every allowed length
of a match is validated: the usual one of the card's issuer or the IBAN's country first, then the
longest. All places where a pattern can start are tried, from the left; what a replaced value leaves
over, or a match without a valid length, is searched on.

What does not validate stays as it is. Everything happens within a row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Dates are permuted among the 17 * 4297 days of 1900-01-01 to 2099-12-31, all that the patterns take.
_DAYS = (17, 4297)
_DAY0 = "1900-01-01"

#: Kinds in the order in which they are tried at a place of the text.
PATTERNS = {
    # within an address, only places where another kind's match can have ended are tried
    "email": r"(?:(?<![A-Za-z0-9._%+-])|(?<=[0-9])(?![0-9])|(?<=[A-Za-z0-9+/_-])(?=[.%_+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": (r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])[0-9a-f]{32,128}(?![A-Za-z0-9])"
               r"|(?<=(?:password|passwd|secret|token|apikey|api_key)=)[A-Za-z0-9+/_-]{8,}"),
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": (r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|(?:19|20)[0-9]{2}/[0-9]{2}/[0-9]{2}"
             r"|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9/]|[.-][0-9])"),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": (r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
              r"|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}[-.][0-9]{4}(?![0-9])|(?<![0-9A-Za-z.-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9]|[.-][0-9])"),
}
#: Every place where a kind starts, with its match as group 1.
_STARTS = "(?=(" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + "))"
#: Country codes by IBAN length.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
#: A text with none of these holds none of the kinds.
_HINT = r"[0-9@]|(?:password|passwd|secret|token|apikey|api_key)="


def _prf(key: str, tweak: Column, step: Column, value: Column) -> Column:
    """A keyed 60-bit number of (tweak, step, value)."""
    text = F.concat_ws("\x1f", F.lit(key), tweak, step.cast("string"), value.cast("string"), F.lit(key))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def permute(left: Column, right: Column, a: Column | int, b: Column | int, key: str, tweak: Column) -> Column:
    """A keyed permutation of the pairs Z_a x Z_b, as a struct (l, r): alternating Feistel rounds."""
    a, b = (F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint") for x in (a, b))

    def step(s: Column, i: Column) -> Column:
        left = (s["l"] + F.pmod(_prf(key, tweak, i, s["r"]), a)) % a
        right = (s["r"] + F.pmod(_prf(key, tweak, i, s["l"]), b)) % b
        return F.struct(F.when(i % 2 == 0, left).otherwise(s["l"]).alias("l"), F.when(i % 2 == 1, right).otherwise(s["r"]).alias("r"))

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.aggregate(F.array(F.lit(0)), value, lambda acc, _: acc, use)


def permute_digits(digits: Column, key: str, tweak: Column) -> Column:
    """A digit string (1 to 19 digits) permuted among all of its length."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("bigint")
    left = F.substring(digits, F.lit(1), n - low).cast("bigint")
    right = F.when(low > 0, F.substring(digits, n - low + 1, low)).otherwise("0").cast("bigint")
    done = permute(left, right, power(n - low), power(low), key, tweak)
    return _let(done, lambda s: F.concat(F.lpad(s["l"].cast("string"), n - low, "0"),
                                         F.when(low > 0, F.lpad(s["r"].cast("string"), low, "0")).otherwise("")))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(text: Column, digits: Column, skip: Column | int = 0) -> Column:
    """``text`` with its digits after the first ``skip`` replaced, in order, by ``digits``; other characters stay."""
    skip = F.lit(skip) if isinstance(skip, int) else skip
    before = lambda i: F.length(_digits(F.substring(text, F.lit(1), i)))
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(
        c.rlike("[0-9]") & (before(i) >= skip), F.substring(digits, before(i) - skip + 1, F.lit(1))).otherwise(c)), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""
    turned = F.split(F.reverse(digits), "")
    worth = F.transform(turned, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """The remainder that IBAN check digits are made of: letters count as 10 to 35."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97))


def _card(m: Column, key: str) -> Column:
    def use(d: Column) -> Column:
        body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, F.lit("card"))
        return _let(body, lambda x: F.when(_luhn_sum(d) % 10 == 0, _refill(m, F.concat(
            x, ((10 - _luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))))
    return _let(_digits(m), use)


def _iban(m: Column, key: str) -> Column:
    def use(t: Column) -> Column:
        inner = F.substring(t, F.lit(5), F.length(t))
        d = _digits(inner)
        # long account numbers are permuted in two parts of at most 19 digits
        first, second = F.substring(d, F.lit(1), F.lit(18)), F.substring(d, F.lit(19), F.lit(18))
        tweak = F.concat(F.lit("iban"), F.substring(t, F.lit(1), F.lit(2)), F.regexp_replace(inner, "[0-9]", "0"))
        new = F.concat(F.when(F.length(first) > 0, permute_digits(first, key, F.concat(tweak, second))).otherwise(""),
                       F.when(F.length(second) > 0, permute_digits(second, key, tweak)).otherwise(""))
        # the second part is permuted alone, the first depends on the old second one: equal values stay equal
        filled = _let(new, lambda x: F.concat(F.substring(t, F.lit(1), F.lit(2)), F.lit("00"), _refill(inner, x)))
        checked = _let(filled, lambda x: F.concat(F.substring(x, F.lit(1), F.lit(2)), F.lpad((98 - _mod97(x)).cast("string"), 2, "0"),
                                                  F.substring(x, F.lit(5), F.length(x))))
        valid = F.length(t).between(15, 34) & (_mod97(t) == 1)
        return F.when(valid, _let(checked, lambda x: _refill(m, _digits(x))))
    return _let(F.regexp_replace(m, " ", ""), use)


def _first_valid(m: Column, pattern: str, sizes: range, valid, usual: Column) -> Column:
    """The prefix of ``m`` that is valid and ends at a border: the one of ``usual`` characters (separators
    do not count), else the longest; null if there is none. ``pattern`` holds ``%d`` for the size less one."""
    parts = F.filter(F.array(*[F.regexp_extract(m, pattern % (k - 1), 0) for k in sizes]), lambda x: (x != "") & valid(x))
    fits = lambda x: F.length(F.regexp_replace(x, "[ -]", "")) == usual
    return _let(parts, lambda p: F.coalesce(F.get(F.filter(p, fits), F.lit(0)), F.get(p, F.lit(0))))


def _card_part(m: Column) -> Column:
    d = F.substring(_digits(m), 1, 4)
    usual = F.when(d.rlike("^(?:4|5[1-5]|2[2-7]|35|6011|65)"), 16).when(d.rlike("^3[47]"), 15).when(d.rlike("^3[0689]"), 14)
    found = _first_valid(m, r"^[0-9](?:[ -]?[0-9]){%d}(?![0-9])", range(19, 12, -1), lambda x: _luhn_sum(_digits(x)) % 10 == 0, usual)
    phone = F.regexp_extract(m, r"^[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9]|[.-][0-9])", 0)  # with digits after it
    return F.coalesce(found, F.when(phone != "", phone))


def _iban_part(m: Column) -> Column:
    country, usual = F.substring(m, 1, 2), F.lit(None).cast("int")
    for n, codes in _IBAN_LENGTHS.items():
        usual = F.when(country.isin(*codes.split()), n).otherwise(usual)
    return _first_valid(m, r"^[A-Z0-9](?: ?[A-Z0-9]){%d}(?![A-Za-z0-9])", range(34, 14, -1),
                        lambda x: _mod97(F.regexp_replace(x, " ", "")) == 1, usual)


def _phone_part(m: Column) -> Column:
    groups = [F.regexp_extract(m, PATTERNS["phone"].split("|(?<!")[0].replace("{2,4}(?![0-9])", "{%d}(?![0-9])" % n), 0) for n in (4, 3, 2)]
    return F.coalesce(*[F.when(F.length(_digits(g)).between(7, 15), g) for g in groups])


def valid_part(m: Column) -> Column:
    """The beginning of a match that validates, without what its pattern took along; else the match."""
    part = F.when(m.rlike(f"^(?:{PATTERNS['card']})$"), _card_part(m)).when(m.rlike(f"^(?:{PATTERNS['iban']})$"), _iban_part(m))
    return F.coalesce(part.when(m.startswith("+") & m.rlike(f"^(?:{PATTERNS['phone']})$"), _phone_part(m)), m)


def _ip(m: Column, key: str) -> Column:
    def use(o: Column) -> Column:
        part = lambda i: F.get(o, F.lit(i)).cast("bigint")
        done = permute(part(0) * 256 + part(1), part(2) * 256 + part(3), 65536, 65536, key, F.lit("ip"))
        octets = lambda s: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), s[h] % 256)])
        return F.when(F.forall(o, lambda x: x.cast("int") <= 255), _let(done, octets))
    return _let(F.split(m, r"\."), use)


def _date(m: Column, key: str) -> Column:
    def use(shape: str) -> Column:
        day = F.try_to_date(m, shape)
        n = F.datediff(day, F.lit(_DAY0).cast("date"))
        done = permute(F.floor(n / _DAYS[1]), n % _DAYS[1], *_DAYS, key, F.lit("date"))
        back = lambda s: F.date_format(F.date_add(F.lit(_DAY0).cast("date"), (s["l"] * _DAYS[1] + s["r"]).cast("int")), shape)
        return F.when(day.isNotNull(), _let(done, back))

    shapes = [F.when(m.rlike(r"^[0-9]{4}-"), use("yyyy-MM-dd")), F.when(m.rlike(r"^[0-9]{4}/"), use("yyyy/MM/dd")),
              F.when(m.rlike(r"^[0-9]{2}\."), use("dd.MM.yyyy")), F.when(m.rlike(r"^[0-9]{2}/"), use("MM/dd/yyyy")),
              F.when(m.rlike(r"^[0-9]{2}/"), use("dd/MM/yyyy"))]
    return F.coalesce(*shapes)


def _ssn(m: Column, key: str) -> Column:
    valid = ~m.rlike(r"^(?:000|666|9)|^...-00|0000$")
    # 898 areas (001 to 899 without 666), 99 groups, 9,999 serials
    part = lambda i, n: F.substring(m, i, n).cast("bigint")
    area = part(1, 3)
    rest = (part(5, 2) - 1) * 9999 + part(8, 4) - 1
    done = permute(area - F.when(area < 666, 1).otherwise(2), rest, 898, 99 * 9999, key, F.lit("ssn"))
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.when(valid, _let(done, lambda s: F.concat_ws(
        "-", pad(s["l"] + F.when(s["l"] < 665, 1).otherwise(2), 3), pad(F.floor(s["r"] / 9999) + 1, 2), pad(s["r"] % 9999 + 1, 4))))


def _phone(m: Column, key: str) -> Column:
    country = F.length(F.regexp_extract(m, r"^\+([0-9]{1,3})", 1))
    d = _digits(m)
    return F.when(F.length(d).between(7, 15), _refill(m, permute_digits(F.substring(d, country + 1, F.length(d)), key, F.lit("phone")), country))


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(key), F.lit("email"), F.lower(m), F.lit(key)), 256), 1, 16), F.lit("@example.invalid"))


def _secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^AKIA(?=[0-9A-Z]{16}$)", 0)
    block = lambda i: F.sha2(F.concat(F.lit(key), F.lit(f"secret{i}"), m, F.lit(key)), 256)
    body = F.substring(F.rpad(F.concat(block(0), block(1)), F.length(m), "0"), F.lit(1), F.length(m) - F.length(head))
    return F.concat(head, F.when(F.length(head) > 0, F.upper(body)).otherwise(body))


_KINDS = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}
#: Patterns that a whole match is told by; lookbehinds of a match's surroundings do not apply to it alone.
_WHOLE = {"secret": r"AKIA[0-9A-Z]{16}|[0-9a-f]{32,128}"}


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of one match; null if it does not validate as the kind whose pattern it has."""
    out = None
    for kind, make in _KINDS.items():
        if kind == "phone":
            test = match.rlike(f"^(?:{PATTERNS['phone']})$")
        else:
            test = match.rlike(f"^(?:{_WHOLE.get(kind, PATTERNS[kind])})$")
        out = F.when(test, make(match, key)) if out is None else out.when(test, make(match, key))
    return out.otherwise(_secret(match, key))  # only a secret after "password=" fits no whole pattern


def _covered(rows: Column) -> Column:
    """For each place: the size of the value replaced there, 0 if none is, or, negative, how many
    characters from there on belong to a value replaced before."""
    def step(acc: Column, r: Column) -> Column:
        free = acc["over"] == 0
        held = F.when(free, r["size"]).otherwise(acc["over"])
        return F.struct(F.greatest(held - F.length(r["gap"]), F.lit(0)).alias("over"),
                        F.concat(acc["out"], F.array(F.when(free, held).otherwise(-held))).alias("out"))

    start = F.struct(F.lit(0).alias("over"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def pseudonymise(docs: DataFrame, key: str = "kiln-pseudonyms-1", column: str = "text", count: str = "n_replaced") -> DataFrame:
    """``docs`` with the personal data of ``column`` replaced, and their number ``count`` (bigint) added, last.

    A null text stays null, with 0 replaced; an empty text and a text without personal data stay as
    they are, byte for byte. Repeated rows get equal results. An existing column of the name ``count`` is
    replaced; all others pass unchanged. An empty table gives an empty table. ``key`` is the secret.
    """
    names = [c for c in docs.columns if c != count]
    text = F.col(column)
    fresh = "_found"
    while fresh in names:
        fresh += "_"
    hinted = F.coalesce(text.rlike(_HINT), F.lit(False))
    found = F.when(hinted, F.regexp_extract_all(text, F.lit(_STARTS), F.lit(1)))
    some = docs.select(*[F.col(f"`{c}`") for c in names], found.alias(fresh))
    new = F.transform(F.col(fresh), lambda m: _let(valid_part(m), lambda x: F.struct(F.length(x).alias("size"), pseudonym(x, key).alias("new"))))
    some = some.withColumn(fresh, F.when(F.size(fresh) > 0, F.struct(F.split(text, _STARTS, -1).alias("gaps"), new.alias("found"))))
    # a place at the text's begin has no gap before it
    head = F.when(F.size(F.col(fresh)["gaps"]) > F.size(F.col(fresh)["found"]), F.get(F.col(fresh)["gaps"], F.lit(0))).otherwise("")
    tails = F.slice(F.col(fresh)["gaps"], -F.size(F.col(fresh)["found"]), F.size(F.col(fresh)["found"]))
    rows = F.zip_with(tails, F.col(fresh)["found"], lambda g, m: F.struct(
        g.alias("gap"), m["new"].alias("new"), F.when(m["new"].isNotNull(), m["size"]).otherwise(0).alias("size")))
    some = some.withColumn(fresh, F.when(F.col(fresh).isNotNull(), F.struct(head.alias("head"), rows.alias("rows"))))
    some = some.withColumn(fresh, F.when(F.col(fresh).isNotNull(), F.struct(
        F.col(fresh)["head"].alias("head"),
        F.zip_with(F.col(fresh)["rows"], _covered(F.col(fresh)["rows"]), lambda r, c: F.struct(
            r["gap"].alias("gap"), r["new"].alias("new"), c.alias("covered"))).alias("rows"))))
    pieces = F.transform(F.col(fresh)["rows"], lambda r: F.concat(
        F.when(r["covered"] > 0, r["new"]).otherwise(""), F.substring(r["gap"], F.abs(r["covered"]) + 1, F.length(r["gap"]))))
    done = F.when(F.col(fresh).isNotNull(), F.concat(F.col(fresh)["head"], F.array_join(pieces, ""))).otherwise(text)
    changed = F.coalesce(F.size(F.filter(F.col(fresh)["rows"], lambda r: r["covered"] > 0)), F.lit(0))
    return some.select(*[done.alias(c) if c == column else F.col(f"`{c}`") for c in names], changed.cast("bigint").alias(count))


def pseudonymise_documents(docs: DataFrame, key: str = "kiln-pseudonyms-1") -> DataFrame:
    """The columns of ``docs``, with ``text`` pseudonymised and ``n_chars`` its new length."""
    count = "n_replaced"
    while count in docs.columns:
        count += "_"
    done = pseudonymise(docs, key, count=count)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])
