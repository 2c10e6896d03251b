"""Pseudonyms against a plain Python version of the same network."""

import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from plumbline.llm import pseudonyms as P

KEY = "k1"


def feistel(x, a, b, kind):
    left, right = divmod(x, b)
    for i in range(P.ROUNDS):
        said = f"{KEY}:{kind}:{a}:{b}:{i}:"
        if i % 2 == 0:
            left = (left + int(hashlib.sha256(f"{said}{right}".encode()).hexdigest()[:15], 16) % a) % a
        else:
            right = (right + int(hashlib.sha256(f"{said}{left}".encode()).hexdigest()[:15], 16) % b) % b
    return left * b + right


def digits_of(d, kind):
    h = len(d) // 2
    return str(feistel(int(d), 10**h, 10 ** (len(d) - h), kind)).rjust(len(d), "0")


def refill(shape, new):
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn(d):
    return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def as_date(hit):
    parts = [int(x) for x in re.split(r"[./-]", hit)]
    if "-" in hit:
        y, m, d = parts
        first = None
    else:
        if re.findall(r"[./]", hit)[0] != re.findall(r"[./]", hit)[1]:
            return None
        first = parts[1] > 12
        m, d = (parts[0], parts[1]) if first else (parts[1], parts[0])
        y = parts[2]
    try:
        return (datetime.date(y, m, d), first) if 1800 <= y <= 2199 else None
    except ValueError:
        return None


def brute(hit):
    d = re.sub(r"\D", "", hit)
    if "@" in hit:
        return "mail", "user" + hashlib.sha256(f"{KEY}:mail:{hit.lower()}".encode()).hexdigest()[:12] + "@mail.invalid"
    if re.match("[A-Z]", hit):
        bare = hit.replace(" ", "")
        if mod97(bare[4:] + bare[:4]) != 1:
            return None, hit
        tail = re.sub(r"\D", "", bare[4:])
        moved = "".join(digits_of(c, f"account{at}") if len(c) > 1 else c for at, c in ((1, tail[:16]), (17, tail[16:])))
        new = refill(bare[4:], moved)
        return "account", refill(hit, str(98 - mod97(new + bare[:2] + "00")).rjust(2, "0") + moved)
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4}", hit):
        found = as_date(hit)
        if not found:
            return None, hit
        day, first = found
        new = datetime.date(1800, 1, 1) + datetime.timedelta(feistel((day - datetime.date(1800, 1, 1)).days, 189, 773, "date"))
        if first is None:
            return "date", new.isoformat()
        parts = re.split(r"[./]", hit)
        a, b = (new.month, new.day) if first else (new.day, new.month)
        mark = re.findall(r"[./]", hit)[0]
        return "date", f"{str(a).rjust(2, '0') if len(parts[0]) == 2 else a}{mark}{str(b).rjust(2, '0') if len(parts[1]) == 2 else b}{mark}{new.year}"
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", hit):
        o = [int(x) for x in hit.split(".")]
        if max(o) > 255:
            return None, hit
        n = feistel(o[0] << 24 | o[1] << 16 | o[2] << 8 | o[3], 65536, 65536, "address")
        return "address", ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", hit):
        a, g, s = int(d[:3]), int(d[3:5]), int(d[5:])
        if a in (0, 666) or a > 899 or not g or not s:
            return None, hit
        n = feistel(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99, 9999, "social")
        a = n // (99 * 9999) + 1
        return "social", f"{a + (a >= 666):03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"
    if re.fullmatch(P.PHONE.split(")", 1)[1], hit) or (hit.startswith("+") and 8 <= len(d) <= 15):
        home = 10 <= len(d) <= 11 and not (hit.startswith("+") and not d.startswith("1"))
        keep = len(d) - 10 if home else 2
        return "phone", refill(hit, d[:keep] + digits_of(d[keep:], "phone"))
    if 13 <= len(d) <= 19 and luhn(d) == 0:
        body = digits_of(d[:-1], "card")
        return "card", refill(hit, body + str(-luhn(body + "0") % 10))
    return None, hit


def brute_text(text):
    kinds = []

    def one(m):
        kind, new = brute(m.group())
        kinds.append(kind)
        return new

    return text and re.sub(P.ANY, one, text, flags=re.ASCII), [k for k in kinds if k]


ODD = ["Mail Ann.Lee+x@mail.example.com, or ANN.lee+x@mail.example.com.", "card 4785380592391139 and 4785 3805 9239 1139; bad 4785380592391138", "ip 152.143.123.131. and 300.1.1.1 and 1.2.3.4.5",
       "call +1 (743) 555-3824 or 743-555-3824 or (743) 555-3824 or +44 20 7946 0958", "ssn 123-45-6789 and 666-12-3456 and 000-11-2222", "born 2001-02-29, 2000-02-29, 31.12.1999, 12/31/1999, 1/2/2003 and 1.2/2003",
       "iban DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 DE00370400440532013000", "", None, "no digits at all", "a@b", "x" * 5000 + " 123-45-6789 " + "1" * 60, "é123-45-6789é ñ4785380592391139", "1" * 16, "0000000000000000",
       "2024-01-01" * 2, "v1.2.3.4-5 10.0.0.1/24 1999-12-31 1999-12-31"]


def test_against_plain_python(spark, sf, odd, none):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] * 2 + [(None, ODD[1], 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, found int")
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet").select("doc_id", "text", F.lit(1).alias("found"))
    both = table.unionByName(docs)
    out = P.pseudonymised(both, KEY)
    assert out.columns == ["doc_id", "text", "found"]
    before = sorted((r.doc_id if r.doc_id is not None else -1, str(r.text)) for r in both.collect())
    want = sorted((k, str(brute_text(None if t == "None" else t)[0]), str(brute_text(None if t == "None" else t)[1])) for k, t in before)
    got = sorted((r.doc_id if r.doc_id is not None else -1, str(r.text), str([x.kind for x in r.found])) for r in out.collect())
    assert got == want
    for r in out.filter("size(found) > 0").collect():
        assert all(re.match(P.ANY, r.text[x.place - 1:], re.ASCII) or x.place > 1 for x in r.found)
    assert P.pseudonymised(none, KEY).count() == 0 and P.pseudonymised(odd, KEY).count() == odd.count()


def test_values_stay_valid_distinct_and_linked(spark):
    rng = random.Random(3)
    cards = {c + str(-luhn(c + "0") % 10) for c in (str(rng.randrange(10**14, 10**15)) for _ in range(500))}
    days = {f"{rng.randrange(1800, 2200)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}" for _ in range(500)}
    rows = [(f"{v} and {v[:4]} {v[4:8]} {v[8:12]} {v[12:]}",) for v in cards] + [(f"{v} {v}",) for v in days]
    out = [r.text for r in P.pseudonymised(spark.createDataFrame(rows, "text string"), KEY).collect()]
    moved = [re.sub(" and | ", "|", t, count=1).split("|") for t in out if " and " in t]
    assert all(luhn(a) == 0 and a == b.replace(" ", "") for a, b in moved) and len({a for a, _ in moved}) == len(cards) and not {a for a, _ in moved} <= cards
    dates = [t.split() for t in out if " and " not in t]
    assert all(a == b and datetime.date.fromisoformat(a) for a, b in dates) and len({a for a, _ in dates}) == len(days)


def test_values_inside_a_hit_that_fails(spark):
    card = "4111 1111 1111 1111"
    moved = brute(card)[1]
    rows = [f"no 123 {card}", f"{card} 123 end", f"no 12 {card} 9, {card}", f"1234 123-45-6789 12 then {card}", "bad 4785 3805 9239 1138"]
    assert all(luhn(re.sub(r"\D", "", x)) for x in (f"123 {card}", f"{card} 123", f"12 {card} 9"))  # these hits fail as a whole
    got = {r.i: r for r in P.pseudonymised(spark.createDataFrame(list(enumerate(rows)), "i int, text string"), KEY).collect()}
    social = brute("123-45-6789")[1]
    want = [f"no 123 {moved}", f"{moved} 123 end", f"no 12 {moved} 9, {moved}", f"1234 {social} 12 then {moved}", rows[4]]
    assert [got[i].text for i in range(5)] == want
    assert [[(x.kind, x.place) for x in got[i].found] for i in (0, 3)] == [[("card", 8)], [("social", 6), ("card", 26)]]


def test_small_network_is_a_permutation(spark):
    for a, b in ((7, 11), (1, 5), (10, 100)):
        out = [r.y for r in spark.range(a * b).select(P.feistel(F.col("id"), a, b, "t", KEY).alias("y")).collect()]
        assert sorted(out) == list(range(a * b)) and out == [feistel(x, a, b, "t") for x in range(a * b)]


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a 4111 1111 1111 1111 b", "x", 2, "y")], "doc_id long, text string, hits string, new int, _hits string")
    out = P.pseudonymised(docs, P.DEMO_KEY)
    r = out.first()
    assert out.columns == ["doc_id", "text", "hits", "new", "_hits", "found"] and (r.hits, r.new, r._hits) == ("x", 2, "y")
    assert [(x.kind, x.place) for x in r.found] == [("card", 3)] and r.text[:2] == "a " and r.text[-2:] == " b" and r.text[2:-2] != "4111 1111 1111 1111"


def test_many_values_in_one_text(spark):
    """The text is joined once, so a text full of values takes time in proportion."""
    many = " | ".join(f"4111 1111 1111 1111 and {i}" for i in range(40))
    docs = spark.createDataFrame([(1, many)], "doc_id long, text string")
    r = P.pseudonymised(docs, P.DEMO_KEY).first()
    new = r.text[:19]
    assert len(r.found) == 40 and r.text == " | ".join(f"{new} and {i}" for i in range(40))
    assert all(r.text[x.place - 1:].startswith(new) for x in r.found)
