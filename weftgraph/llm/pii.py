"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

A text is cut at its e-mail addresses, IPv4 addresses, telephone numbers, social security numbers and ISO dates, found
in one pass, leftmost first. Each pattern takes valid values only (octets up to 255, a day that exists, no part of a
social security number all zero), so no match hides another. Card numbers are sought in what lies between: from each
group of digits on, the shortest row of groups of 13 to 19 digits that is Luhn-valid; a row that isn't is sought again
from its next group. Telephone numbers are those of the North American plan (with or without a country code) and
international ones that start with `+` (7 to 15 digits); a national number of another plan is not told from any other
number. An international number goes on over single blanks, dots and hyphens, but not into a value of another kind.

Each value is permuted within its own format: digits stay digits, letters letters of the same case, a card stays
Luhn-valid, an address an address, a date a date and a social security number one that can exist. E-mail domains and
country codes stay. The permutation depends on the key, the kind and the format alone, so equal values have equal
pseudonyms in all documents and different values different ones. Lengths don't change.

The key is the secret: who has it can undo the permutation. It is given by the caller or by the session's KEY_CONF;
without either, each application makes up its own, and pseudonyms link within that application only.

All of it is SQL expressions; there is no shuffle and no state, and work is in proportion to a text's length. No
pattern repeats a group without either a bound or possession, as the JVM matches those by recursion.
"""

from __future__ import annotations

import secrets as random_bytes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import free_name, let, running

KINDS = ("email", "card", "ip", "phone", "ssn", "date")
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Days that exist, so that a date that doesn't is no match.
_DAY = r"(?!0000)(?:[0-9]{4}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))|(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)-02-29)"
#: No part is all zero and the area is not 666. Areas from 900 on are taxpayer numbers of the same format.
_SSN = "(?!000|666)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"
#: The patterns, by kind. Look-arounds let each start at the edge of a run only, so matching is linear.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)++",
    "card": r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": rf"(?<![0-9A-Za-z-]){_SSN}(?![0-9A-Za-z-])",
    "date": rf"(?<![0-9A-Za-z-]){_DAY}(?![0-9A-Za-z-])",
}
NATIONAL = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?|[0-9]{1,3}(?:[ .-]|(?=\())|(?<![0-9][ -])1)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
#: What an international number doesn't go on into: another value, or a card in its usual groups.
_OTHER = "|".join(f"(?:{p})" for p in (PATTERNS["email"], PATTERNS["ip"], PATTERNS["ssn"], PATTERNS["date"], NATIONAL, "[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])", "[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}(?![0-9])"))
INTERNATIONAL = rf"(?<![0-9A-Za-z+])\+[1-9](?:(?:[ .-](?!{_OTHER}))?(?:[0-9]|\([0-9])\)?){{6,14}}(?![0-9A-Za-z])"
PATTERNS["phone"] = rf"(?:{NATIONAL})|(?:{INTERNATIONAL})"
#: All kinds but cards; at one place, the first of them.
ANY = "|".join(f"(?:{PATTERNS[k]})" for k in ("email", "ip", "phone", "ssn", "date"))
#: The place before each group of digits from which on there are enough for a card; group 1 is the longest such row.
START = r"(?<![0-9A-Za-z.-])(?=([0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])))"
#: The setting of a session that holds the key.
KEY_CONF = "spark.weftgraph.pseudonym.key"
#: Groups of digits folded at once, so that long runs of them take linear time.
CHUNK = 128
ROUNDS = 8
#: A Gregorian cycle of 400 years has 146,097 days, 627 * 233. Dates are permuted within their own cycle.
CYCLE, CYCLE_A, CYCLE_B = 146_097, 627, 233

_made: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The key of KEY_CONF, or one made up for this application."""
    given = spark.conf.get(KEY_CONF, None)
    return given or _made.setdefault(spark.sparkContext.applicationId, random_bytes.token_hex(32))


def _digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256)


def _number(digest: Column) -> Column:
    """48 bits of a digest; far above any modulus here, so all residues are alike to one part in 2^31."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def _turned(half: Column, other: Column, tag: Column) -> Column:
    """Each letter and digit of half moves within its class by a keystream that depends on the other half."""
    def char(i: Column) -> Column:
        c = half.substr(i, F.lit(1))
        code = F.ascii(c)
        base = F.when(code.between(48, 57), 48).when(code.between(65, 90), 65).when(code.between(97, 122), 97)
        size = F.when(base == 48, 10).otherwise(26)
        move = F.conv(F.substring(_digest(tag, other, i.cast("string")), 1, 8), 16, 10).cast("long")
        return let(F.struct(code.alias("c"), base.alias("b"), size.alias("n")), lambda v: F.when(v["b"].isNull(), c).otherwise(F.chr(v["b"] + F.pmod(v["c"] - v["b"] + move, v["n"]))))

    return F.when(F.length(half) == 0, half).otherwise(F.concat_ws("", F.transform(F.sequence(F.lit(1), F.greatest(F.length(half), F.lit(1))), char)))


def permuted(value: Column, key: Column, kind: Column | str) -> Column:
    """value with its letters and digits permuted within their classes; other characters stay.

    An even number of Feistel rounds over the two halves. What doesn't change under a round (the classes and the
    length of each half) is part of the tweak only through the length.
    """
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"), F.length(value).cast("string").alias("n"))

    def two(x: Column, k: Column) -> Column:
        left = _turned(x["l"], x["r"], F.concat_ws("|", key, kind, x["n"], k.cast("string"), F.lit("l")))
        return F.struct(left.alias("l"), x["r"].alias("r"), x["n"].alias("n"))

    def other(x: Column, k: Column) -> Column:
        right = _turned(x["r"], x["l"], F.concat_ws("|", key, kind, x["n"], k.cast("string"), F.lit("r")))
        return F.struct(x["l"].alias("l"), right.alias("r"), x["n"].alias("n"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda x, k: F.when(k % 2 == 1, two(x, k)).otherwise(other(x, k)))
    return let(done, lambda x: F.concat(x["l"], x["r"]))


def product_permuted(n: Column, a: Column | int, b: Column | int, key: Column, kind: Column | str) -> Column:
    """A permutation of 0 .. a * b - 1: rounds that turn the two mixed-radix digits by each other."""
    a, b, kind = (x if isinstance(x, Column) else F.lit(x) for x in (a, b, kind))
    start = F.struct(F.floor(n / b).cast("long").alias("x"), F.pmod(n, b).cast("long").alias("y"))

    def step(s: Column, k: Column) -> Column:
        odd = k % 2 == 1
        turn = _number(_digest(key, kind, k.cast("string"), F.when(odd, s["y"]).otherwise(s["x"]).cast("string")))
        return F.struct(F.when(odd, F.pmod(s["x"] + turn, a)).otherwise(s["x"]).cast("long").alias("x"), F.when(odd, s["y"]).otherwise(F.pmod(s["y"] + turn, b)).cast("long").alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["x"] * b + s["y"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by digits."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def within(d: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            c = shape.substr(i, F.lit(1))
            is_digit = F.ascii(c).between(48, 57)
            return F.struct(F.concat(s["out"], F.when(is_digit, d.substr(s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + is_digit.cast("int")).alias("at"))

        return F.aggregate(F.sequence(F.lit(1), F.length(shape)), start, step)["out"]

    return let(digits, within)


def _luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Sum of the digits, each second one doubled from the right; the last one too if doubled_last."""

    def within(d: Column) -> Column:
        n = F.length(d)

        def add(total: Column, i: Column) -> Column:
            x = (F.ascii(d.substr(n - i + 1, F.lit(1))) - 48) * F.when(i % 2 == (1 if doubled_last else 0), 2).otherwise(1)
            return total + x - F.when(x > 9, 9).otherwise(0)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)

    return let(digits, within)


def _pad(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _octets(v: Column) -> Column:
    """array<struct<v, least, size>>: each octet, and the least value and number of values of its length."""
    one = lambda x: F.struct(x.cast("long").alias("v"), F.when(F.length(x) == 1, 0).when(F.length(x) == 2, 10).otherwise(100).cast("long").alias("least"), F.when(F.length(x) == 1, 10).when(F.length(x) == 2, 90).otherwise(156).cast("long").alias("size"))
    return F.transform(F.split(v, r"\."), one)


def _place(octet: Column) -> Column:
    return octet["v"] - octet["least"]


def _plan(v: Column, d: Column, kind: Column) -> Column:
    """struct<n, a, b, body, code>: the number of a value of a kind that is a product of ranges (n of 0 .. a * b - 1);
    of others the body whose characters are permuted. code: digits of a country code, which stay.

    An address keeps the length of each octet. Days are taken within their cycle. Social security numbers have 998 areas (1 to 999
    without 666), 99 groups and 9,999 serials. The last ten digits of a national telephone number keep an area and an
    exchange that start with 2 to 9, if they did; of an international one the code is what lies before its first
    separator, or two digits if these are more than three.
    """
    of = lambda x, a, n: F.substring(x, a, n).cast("long")
    ten = F.substring(d, F.length(d) - 9, F.lit(10))
    national = (kind == "phone") & v.rlike(rf"\A(?:{NATIONAL})\z")
    regular = national & ten.rlike("^[2-9][0-9]{2}[2-9]")
    code = F.when(national, F.length(d) - 10).otherwise(F.length(F.regexp_extract(v, r"\A\+([0-9]{1,3}(?![0-9])|[0-9]{2})", 1)))
    area = of(v, 1, 3)
    ranges = (
        F.when(kind == "ip", let(_octets(v), lambda o: F.struct((_place(o[0]) * o[1]["size"] * o[2]["size"] * o[3]["size"] + _place(o[1]) * o[2]["size"] * o[3]["size"] + _place(o[2]) * o[3]["size"] + _place(o[3])).alias("n"), (o[0]["size"] * o[1]["size"]).cast("int").alias("a"), (o[2]["size"] * o[3]["size"]).cast("int").alias("b"))))
        .when(kind == "date", F.struct(F.pmod(F.unix_date(F.to_date(v)), F.lit(CYCLE)).cast("long").alias("n"), F.lit(CYCLE_A).alias("a"), F.lit(CYCLE_B).alias("b")))
        .when(kind == "ssn", F.struct((((area - 1 - (area > 666).cast("long")) * 99 + of(v, 5, 2) - 1) * 9999 + of(v, 8, 4) - 1).alias("n"), F.lit(998 * 99).alias("a"), F.lit(9999).alias("b")))
        .when(regular, F.struct(((of(ten, 1, 3) - 200) * 8_000_000 + (of(ten, 4, 3) - 200) * 10_000 + of(ten, 7, 4)).alias("n"), F.lit(80_000).alias("a"), F.lit(80_000).alias("b")))
    )
    body = F.when(kind == "email", F.substring_index(v, "@", 1)).when(kind == "card", F.substring(d, F.lit(1), F.length(d) - 1)).when(kind == "phone", F.substring(d, code + 1, F.length(d)))
    return F.struct(ranges.alias("r"), body.alias("body"), F.when(kind == "phone", code).alias("code"))


def pseudonym(value: Column, kind: Column, key: Column) -> Column:
    """The pseudonym of a valid value of a kind."""
    floor = lambda m, x, y: F.pmod(F.floor(m / F.lit(x)), F.lit(y))

    def digits(d: Column) -> Column:
        def planned(p: Column) -> Column:
            m = F.when(p["r"].isNotNull(), product_permuted(p["r"]["n"], p["r"]["a"], p["r"]["b"], key, kind))
            moved = F.when(p["r"].isNull(), permuted(p["body"], key, kind))

            def told(x: Column) -> Column:
                m, moved = x["m"], x["moved"]
                check = F.pmod(10 - F.pmod(_luhn_sum(moved, True), F.lit(10)), F.lit(10)).cast("string")
                plan = F.concat((F.floor(m / F.lit(8_000_000)) + 200).cast("string"), (floor(m, 10_000, 800) + 200).cast("string"), _pad(floor(m, 1, 10_000), 4))
                number = F.when(kind == "card", F.concat(moved, check)).otherwise(F.concat(F.substring(d, F.lit(1), p["code"]), F.coalesce(moved, plan)))
                day = F.floor(F.unix_date(F.to_date(value)) / F.lit(CYCLE)) * CYCLE + m
                k = F.floor(m / F.lit(99 * 9999)) + 1

                def address(o: Column) -> Column:
                    below = F.lit(1).cast("long")
                    out = []
                    for i in (3, 2, 1, 0):
                        out.insert(0, (F.pmod(F.floor(m / below), o[i]["size"]) + o[i]["least"]).cast("string"))
                        below = below * o[i]["size"]
                    return F.concat_ws(".", *out)

                return (
                    F.when(kind == "email", F.concat(moved, F.lit("@"), F.substring_index(value, "@", -1)))
                    .when(kind == "ip", let(_octets(value), address))
                    .when(kind == "date", F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM-dd"))
                    .when(kind == "ssn", F.concat_ws("-", _pad(k + (k > 665).cast("long"), 3), _pad(floor(m, 9999, 99) + 1, 2), _pad(floor(m, 1, 9999) + 1, 4)))
                    .otherwise(_refilled(value, number))
                )

            return let(F.struct(m.alias("m"), moved.alias("moved")), told)

        return let(_plan(value, d, kind), planned)

    return let(_digits(value), digits)


def kind_of(value: Column) -> Column:
    """The kind of a match of ANY."""
    whole = lambda k: value.rlike(rf"\A(?:{PATTERNS[k]})\z")
    return F.when(F.contains(value, F.lit("@")), "email").when(whole("ip"), "ip").when(whole("ssn"), "ssn").when(whole("date"), "date").otherwise("phone")


def _valid_length(row: Column) -> Column:
    """Characters of the shortest card at the start of a row of groups of digits, 0 if there is none.

    One pass over the characters: `a` sums the digits with each odd place doubled, `b` with each even one, so that
    either is the Luhn sum of a card that ends there.
    """
    start = F.struct(*[F.lit(0).alias(c) for c in ("k", "n", "a", "b", "found")])

    def good(s: Column) -> Column:
        return (s["found"] == 0) & s["k"].between(13, 19) & (F.when(s["k"] % 2 == 0, s["a"]).otherwise(s["b"]) % 10 == 0)

    def step(s: Column, c: Column) -> Column:
        def digit(x: Column) -> Column:
            twice = 2 * x - F.when(x > 4, 9).otherwise(0)
            odd = s["k"] % 2 == 0
            return F.struct((s["k"] + 1).alias("k"), (s["n"] + 1).alias("n"), (s["a"] + F.when(odd, twice).otherwise(x)).alias("a"), (s["b"] + F.when(odd, x).otherwise(twice)).alias("b"), s["found"].alias("found"))

        gap = F.struct(s["k"].alias("k"), (s["n"] + 1).alias("n"), s["a"].alias("a"), s["b"].alias("b"), F.when(good(s), s["n"]).otherwise(s["found"]).alias("found"))
        return F.when(c.isin(" ", "-"), gap).otherwise(let(F.ascii(c) - 48, digit))

    return F.aggregate(F.split(row, ""), start, step, lambda s: F.when(good(s), s["n"]).otherwise(s["found"]))


def _pieces(gap: Column) -> Column:
    """array<struct<value, rest>> of a stretch of text: cards, each with the text after it; a head without a card.

    The stretch is cut before each row that could be a card. A card covers the cuts within it: `skip` is what it
    covers still. Cuts are folded CHUNK at a time, as each step of a fold copies what has been gathered.
    """
    piece = "array<struct<value:string,rest:string>>"
    alone = F.array(F.struct(F.lit(None).cast("string").alias("value"), gap.alias("rest")))

    def cut(c: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            n = F.when((s["skip"] == 0) & x["row"].isNotNull(), _valid_length(x["row"])).otherwise(0)

            def told(n: Column) -> Column:
                over = s["skip"] + n
                value = F.when(n > 0, F.substring(x["row"], F.lit(1), n))
                rest = F.when(over == 0, x["part"]).otherwise(F.substring(x["part"], over + 1, F.length(x["part"])))
                return F.struct(F.greatest(F.lit(0), over - F.length(x["part"])).alias("skip"), F.concat(s["out"], F.array(F.struct(value.alias("value"), rest.alias("rest")))).alias("out"))

            return let(n, told)

        def chunk(s: Column, k: Column) -> Column:
            done = F.aggregate(F.slice(c, k * CHUNK + 1, CHUNK), F.struct(s["skip"].alias("skip"), F.array().cast(piece).alias("out")), step)
            return let(done, lambda d: F.struct(d["skip"].alias("skip"), F.concat(s["out"], F.array(d["out"])).alias("out")))

        start = F.struct(F.lit(0).alias("skip"), F.array().cast(f"array<{piece}>").alias("out"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / CHUNK).cast("int")), start, chunk)["out"])

    def rows(found: Column) -> Column:
        def joined(parts: Column) -> Column:
            head = F.when(F.size(parts) > F.size(found), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
            return F.zip_with(F.concat(head, found), parts, lambda r, p: F.struct(r.alias("row"), p.alias("part")))

        return let(let(F.split(gap, START, -1), joined), cut)

    return F.when(gap.rlike(START), let(F.regexp_extract_all(gap, F.lit(START), F.lit(1)), rows)).otherwise(alone)


def pseudonymise(docs: DataFrame, key: str | None = None, text: str = "text", spans: str | None = None) -> DataFrame:
    """docs with the personal data of its text column replaced; every row and other column stays.

    key: by default that of session_key. spans: the name of a further column, array<struct<kind, value, start,
    pseudonym>> in order of place (start in code points from 0). A null text stays null, with no spans; an empty or
    very long one is treated as any other. Repeated rows have the same result. A name in spans that docs has already
    gets underscores.
    """
    t, k = F.col(text), F.lit(session_key(docs.sparkSession) if key is None else key)
    has = F.coalesce(t.rlike("[0-9]|@") & (t.rlike(ANY) | t.rlike(START)), F.lit(False))
    name = free_name(docs, "pii_pieces")
    found = F.regexp_extract_all(t, F.lit(ANY), F.lit(0))

    def joined(values: Column) -> Column:
        own = lambda i: F.when(i < F.size(values), F.array(F.struct(F.get(values, i).alias("value"), F.lit("").alias("rest"), F.lit(False).alias("card")))).otherwise(F.array().cast("array<struct<value:string,rest:string,card:boolean>>"))
        cards = lambda gap: F.transform(_pieces(gap), lambda p: F.struct(p["value"].alias("value"), p["rest"].alias("rest"), F.lit(True).alias("card")))
        return F.flatten(F.transform(F.split(t, ANY, -1), lambda gap, i: F.concat(cards(gap), own(i))))

    def told(p: Column) -> Column:
        kind = F.when(p["value"].isNull(), None).when(p["card"], "card").otherwise(kind_of(p["value"]))
        moved = lambda kind: F.struct(kind.alias("kind"), p["value"].alias("value"), F.when(kind.isNull(), "").otherwise(pseudonym(p["value"], kind, k)).alias("pseudonym"), p["rest"].alias("rest"))
        return let(kind, moved)

    cut = docs.withColumn(name, F.when(has, F.transform(let(found, joined), told)))
    pieces = F.col(name)
    out = cut.withColumn(text, F.when(pieces.isNotNull(), F.array_join(F.transform(pieces, lambda p: F.concat(p["pseudonym"], p["rest"])), "")).otherwise(t))
    if spans:
        lengths = F.transform(pieces, lambda p: F.coalesce(F.length(p["value"]), F.lit(0)) + F.length(p["rest"]))
        placed = F.zip_with(pieces, running(lengths), lambda p, at: F.struct(p["kind"].alias("kind"), p["value"].alias("value"), at.alias("start"), p["pseudonym"].alias("pseudonym")))
        none = F.array().cast("array<struct<kind:string,value:string,start:int,pseudonym:string>>")
        out = out.withColumn(free_name(docs, spans), F.when(pieces.isNotNull(), F.filter(placed, lambda m: m["kind"].isNotNull())).otherwise(none))
    return out.drop(name)
