"""Personal data replaced by format-preserving pseudonyms, with DataFrame functions only.

Numbers and dates that pass their own check (Luhn, octets, calendar, number ranges, mod 97) are permuted within their format by a keyed Feistel
network: a value becomes a pair (left, right) of Z_A x Z_B with A * B the exact count of values of the format, and rounds add keyed hashes to either half
in turn, modulo A or B. So every pseudonym is valid again, different values stay different, and equal values stay equal in all documents,
however they are punctuated. Dates move within the 400 years from 1800 on. Mail addresses, which are no numbers, become keyed names.

Defined results: a null text stays null; an empty text stays empty; a number that fails its check is no such number and stays, except for the values
inside it (runs of its groups of digits that are written as a kind and pass its check; longer runs first, then earlier ones; dates stay there, and cards with both spaces and hyphens); repeated
rows get equal texts; an empty table has no rows. Input columns stay; ``text`` is replaced and ``found`` (an array of kind and place) is new
(a column of that name is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import hex_long, unused

ROUNDS = 8
# The registered query has no secret; real use passes its own key.
DEMO_KEY = "demo-key"

# How the kinds are written. Lookarounds keep them from starting or ending inside a longer number or word.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+"
ISO_DATE = r"(?<![\w.-])\d{4}-\d{2}-\d{2}(?![\w-])"
DAY_DATE = r"(?<![\w./])\d{1,2}([./])\d{1,2}\1\d{4}(?![\w/]|\.\d)"
ADDRESS = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
SOCIAL = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<![\w.])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"
ABROAD = r"(?<![\w.])\+(?!1[ .(-])\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?!\w)"
CARD = r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?!\w|[ -]\d)"
ACCOUNT = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
# Group numbers shift when patterns are joined, so the separator of a date is spelled out.
ANY = "|".join((MAIL, ISO_DATE, DAY_DATE.replace("([./])", "[./]").replace(r"\1", "[./]"), ADDRESS, SOCIAL, PHONE, ABROAD, CARD, ACCOUNT))
HINT = r"@|\d[\d ().:/+-]{5,}\d|[A-Z]{2}\d{2} ?[A-Z0-9]{4}"


def feistel(number: Column, a: int | Column, b: int | Column, kind: str, key: str) -> Column:
    """A keyed permutation of 0 .. a * b - 1."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))

    def hashed(i: Column, x: Column, modulus: Column) -> Column:
        return hex_long(F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), a, b, i, x).cast("binary"), 256), 15) % modulus

    def turn(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + hashed(i, s["r"], a), a)
        right = F.pmod(s["r"] + hashed(i, s["l"], b), b)
        return F.when(i % 2 == 0, F.struct(left.alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), right.alias("r")))

    start = F.struct(F.floor(number.cast("decimal(20,0)") / b.cast("decimal(20,0)")).cast("long").alias("l"), (number % b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def padded(number: Column, width: Column) -> Column:
    return F.lpad(number.cast("string"), width, F.lit("0"))


def permuted_digits(text: Column, kind: str, key: str) -> Column:
    """A string of 2 to 18 digits, permuted among the strings of its length."""
    n = F.length(text)
    power = lambda e: F.rpad(F.lit("1"), e + 1, F.lit("0")).cast("long")
    half = F.floor(n / 2).cast("int")
    return padded(feistel(text.cast("long"), power(half), power(n - half), kind, key), n)


def refill(shape: Column, new: Column) -> Column:
    """``shape`` with its digits replaced, in turn, by those of ``new``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))

    def put(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(new, s["i"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["i"] + digit.cast("int")).alias("i"))

    return F.aggregate(F.split(shape, ""), start, put, lambda s: s["out"])


def luhn_sum(number: Column, double_last: bool) -> Column:
    """Sum of Luhn's check; the last digit counts double if ``double_last``."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        twice = (i % 2 == 0) if double_last else (i % 2 == 1)
        return total + F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def mod97(text: Column) -> Column:
    """The number in which letters stand for 10 to 35, modulo 97."""
    def step(m: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (m * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((m * 100 + letter) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _date(text: Column, key: str) -> tuple[Column, Column]:
    """(is a date from 1800 to 2199, pseudonym in the same format); day first, month first if only that is a date."""
    iso = text.rlike(r"^\d{4}-")
    part = F.split(text, r"[./-]")
    number = lambda i: F.element_at(part, i).cast("int")
    year, one, two = F.when(iso, number(1)).otherwise(number(3)), F.when(iso, number(3)).otherwise(number(1)), number(2)
    month_first = ~iso & (two > 12)
    month, day = F.when(month_first, one).otherwise(two), F.when(month_first, two).otherwise(one)
    long_month = month.isin(1, 3, 5, 7, 8, 10, 12)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last = F.when(long_month, 31).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(30)
    valid = (iso | (F.regexp_extract(text, r"^\d+([./])", 1) == F.regexp_extract(text, r"([./])\d+$", 1))) & year.between(1800, 2199) & month.between(1, 12) & (day >= 1) & (day <= last)
    day_one = F.lit("1800-01-01").cast("date")
    index = F.datediff(F.when(valid, F.concat_ws("-", padded(year, F.lit(4)), padded(month, F.lit(2)), padded(day, F.lit(2)))).cast("date"), day_one).cast("long")
    new = F.date_add(day_one, feistel(index, 189, 773, "date", key).cast("int"))  # 189 * 773 = 146097 days in 400 years
    wide = F.length(F.element_at(part, 1)) == 2
    mark = F.regexp_extract(text, r"^\d+([./])", 1)
    y, m, d = F.year(new).cast("string"), F.month(new).cast("string"), F.dayofmonth(new).cast("string")
    fill = lambda x, full: F.when(full, F.lpad(x, 2, "0")).otherwise(x)
    narrow_two = F.length(F.element_at(part, 2)) == 2
    first, second = F.when(month_first, m).otherwise(d), F.when(month_first, d).otherwise(m)
    return valid, F.when(iso, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).otherwise(F.concat(fill(first, wide), mark, fill(second, narrow_two), mark, y))


def kind_of(hit: Column) -> Column:
    """Which kind a piece of text is, or null if it fails the check of its kind."""
    d = digits(hit)
    octets = F.forall(F.split(hit, r"\."), lambda x: F.length(x).between(1, 3) & (x.cast("int") <= 255))
    bare = F.regexp_replace(hit, " ", "")
    area, group, serial = F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4)
    return (F.when(F.contains(hit, F.lit("@")), "mail")
            .when(hit.rlike(r"^[A-Z]"), F.when(mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1, "account"))
            .when(hit.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})$"), F.when(_date(hit, "")[0], "date"))
            .when(hit.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), F.when(octets, "address"))
            .when(hit.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when((area != "000") & (area != "666") & (area < "900") & (group != "00") & (serial != "0000"), "social"))
            .when(hit.rlike("^" + PHONE.split(")", 1)[1] + "$"), "phone")
            .when(hit.startswith("+"), F.when(F.length(d).between(8, 15), "phone"))
            .when(F.length(d).between(13, 19), F.when(luhn_sum(d, False) % 10 == 0, "card")))


def pseudonym(hit: Column, kind: Column, key: str) -> Column:
    d = digits(hit)
    n = F.length(d)
    name = F.concat(F.lit("user"), F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit("mail"), F.lower(hit)).cast("binary"), 256), 1, 12), F.lit("@mail.invalid"))
    octet = lambda i: F.element_at(F.split(hit, r"\."), i).cast("long")
    address = feistel(octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4), 65536, 65536, "address", key)
    # Social numbers: areas 001-899 without 666, groups 01-99, serials 0001-9999, counted without gaps.
    area = F.substring(d, 1, 3).cast("long")
    social = ((area - 1 - (area > 666).cast("long")) * 99 + F.substring(d, 4, 2).cast("long") - 1) * 9999 + F.substring(d, 6, 4).cast("long") - 1
    moved = feistel(social, 898 * 99, 9999, "social", key)
    moved_area = F.floor(moved / (99 * 9999)).cast("long") + 1
    new_social = F.concat_ws("-", padded(moved_area + (moved_area >= 666).cast("long"), F.lit(3)), padded(F.floor(moved / 9999).cast("long") % 99 + 1, F.lit(2)),
                             padded(moved % 9999 + 1, F.lit(4)))
    # Home numbers: ten digits after an optional 1. Others keep two leading digits, which hold the country.
    home = n.between(10, 11) & ~(hit.startswith("+") & ~d.startswith("1"))
    keep = F.when(home, n - 10).otherwise(F.lit(2))
    phone = F.concat(F.substring(d, F.lit(1), keep), permuted_digits(F.substring(d, keep + 1, n), "phone", key))
    body = permuted_digits(F.substring(d, F.lit(1), n - 1), "card", key)
    card = F.concat(body, F.pmod(10 - luhn_sum(body, True) % 10, F.lit(10)).cast("string"))
    # Accounts: digits behind the check digits move in groups of at most 18, letters stay, check digits are made new.
    bare = F.regexp_replace(hit, " ", "")
    tail = digits(F.substring(bare, F.lit(5), F.length(bare)))
    chunk = lambda at: F.substring(tail, at, 16)
    piece = lambda at: F.when(F.length(chunk(at)) > 1, permuted_digits(chunk(at), f"account{at}", key)).otherwise(chunk(at))
    new_tail = refill(F.substring(bare, F.lit(5), F.length(bare)), F.concat(piece(1), piece(17)))
    check = padded(98 - mod97(F.concat(new_tail, F.substring(bare, 1, 2), F.lit("00"))), F.lit(2))
    account = refill(hit, F.concat(check, digits(new_tail)))
    part = lambda s: F.pmod(F.shiftright(address, s), F.lit(256)).cast("string")
    return (F.when(kind == "mail", name).when(kind == "date", _date(hit, key)[1]).when(kind == "address", F.concat_ws(".", part(24), part(16), part(8), part(0)))
            .when(kind == "social", new_social).when(kind == "phone", refill(hit, phone)).when(kind == "card", refill(hit, card))
            .when(kind == "account", account).otherwise(hit))


def inner_values(hit: Column) -> Column:
    """A piece of text that fails its check, as an array of (hit, kind): runs of its groups that are values themselves, and what is between."""
    part = F.regexp_extract_all(hit, F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]+"), 0)
    n = F.size(part)
    group = lambda i: F.element_at(part, i).rlike("^[A-Za-z0-9]")
    text = lambda i, j: F.array_join(F.slice(part, i, j - i + 1), "")
    places = F.filter(F.sequence(F.lit(1), n), group)
    runs = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j >= i), lambda j: F.struct(
        i.alias("i"), j.alias("j"), text(i, j).alias("hit")))))
    runs = F.filter(runs, lambda r: F.length(r["hit"]) >= 7)
    runs = F.filter(F.transform(F.filter(runs, lambda r: r["hit"].rlike(f"^(?:{ANY})$")), lambda r: F.struct(
        (-F.length(digits(r["hit"]))).alias("rank"), r["i"].alias("i"), r["j"].alias("j"), r["hit"].alias("hit"), kind_of(r["hit"]).alias("kind"))), lambda r: r["kind"].isNotNull())
    # Dates stay, and digits of dates in a row are no card: only runs with one kind of separator are.
    runs = F.filter(runs, lambda r: (r["kind"] != "date") & ~((r["kind"] == "card") & r["hit"].rlike(" ") & r["hit"].rlike("-")))
    value = "struct<i:int,j:int,hit:string,kind:string>"

    def take(s: Column, r: Column) -> Column:
        new = F.struct(r["i"].alias("i"), r["j"].alias("j"), r["hit"].alias("hit"), r["kind"].alias("kind")).cast(value)
        return F.when(F.exists(s, lambda x: (x["i"] <= r["j"]) & (r["i"] <= x["j"])), s).otherwise(F.concat(s, F.array(new)))

    taken = F.aggregate(F.array_sort(runs), F.array().cast(f"array<{value}>"), take)
    inside = lambda i: F.exists(taken, lambda x: (x["i"] <= i) & (i <= x["j"]))
    loose = F.transform(F.filter(F.sequence(F.lit(1), n), lambda i: ~inside(i)), lambda i: F.struct(
        i.alias("i"), i.alias("j"), F.element_at(part, i).alias("hit"), F.lit(None).cast("string").alias("kind")).cast(value))
    return F.transform(F.array_sort(F.concat(taken, loose)), lambda x: F.struct(x["hit"].alias("hit"), x["kind"].alias("kind")))


def pseudonymised(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``documents`` with pseudonyms in ``text`` and ``found``: kind and place (from 1, in the new text) of each. ``key`` is the secret.

    A column ``found`` is replaced; all other columns stay, whatever their names.
    """
    t = F.col(text)
    hits, new = unused(documents, "hits"), unused(documents, "new")
    raw = F.when(t.rlike(HINT), F.regexp_extract_all(t, F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))
    marked = documents.withColumn(hits, F.transform(raw, lambda h: F.struct(h.alias("hit"), kind_of(h).alias("kind"))))
    # A hit is one piece, or several if it fails its check and has values inside.
    whole = lambda h: F.array(F.struct(h["hit"].alias("hit"), h["kind"].alias("kind")))
    marked = marked.withColumn(hits, F.transform(hits, lambda h: F.when(h["kind"].isNull(), inner_values(h["hit"])).otherwise(whole(h))))
    renamed = lambda h: F.struct(h["kind"].alias("kind"), F.coalesce(pseudonym(h["hit"], h["kind"], key), h["hit"]).alias("new"))
    # What lies between hits and the new hits in turn: the pattern splits where it matched. One join makes the text.
    between = F.split(t, ANY, -1)
    plain = lambda i: F.struct(F.lit(None).cast("string").alias("kind"), F.coalesce(F.element_at(between, i), F.lit("")).alias("new"))
    marked = marked.withColumn(new, F.when(F.size(hits) > 0, F.concat(F.array(plain(F.lit(1))), F.flatten(F.transform(
        hits, lambda p, i: F.concat(F.transform(p, renamed), F.array(plain(i + 2))))))))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<kind:string,place:int>>").alias("found"))

    def place(s: Column, x: Column) -> Column:
        here = F.struct(x["kind"].alias("kind"), s["at"].alias("place"))
        return F.struct((s["at"] + F.length(x["new"])).alias("at"), F.when(x["kind"].isNotNull(), F.concat(s["found"], F.array(here))).otherwise(s["found"]).alias("found"))

    found = F.when(F.col(new).isNull(), start["found"]).otherwise(F.aggregate(new, start, place)["found"])
    out = F.when(F.col(new).isNull(), t).otherwise(F.array_join(F.transform(new, lambda x: x["new"]), ""))
    return marked.withColumns({"found": found, text: out}).drop(hits, new)
