"""Format-preserving pseudonyms for personal data.

Candidates are found by one pattern, validated by kind (Luhn sums, octets, calendar,
number blocks that are given out) and replaced by a keyed permutation of the values
of that format: a Feistel network over two parts L < A and R < B, each round adding a
keyed hash of one part to the other modulo its size.  Equal values get equal
pseudonyms in every document, different values of a format different ones.  Only
DataFrame functions run, there is no shuffle, and work is per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: For production, pass a secret key; the pseudonyms can be undone with it.
DEMO_KEY = "loomspark-demo-key"
ROUNDS = 8
KINDS = ("email", "ip", "date", "ssn", "phone", "card")

# Fixed forms.
# (lengths as in the standards of mail and of domain names; the repeats are bounded or possessive, so that no text can exhaust the stack)
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,254}+@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
DATE = r"(?<![\d.])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?!\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!\d|-\d)"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
# a whole run of digits with single separators, however long; _pieces finds the cards in it
CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,}+"
# how a card starts that stands in a run with other numbers: prefixes that issuers have
ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6[0245])"
PATTERN = "|".join((EMAIL, IP, DATE, SSN, PHONE, CARD))
FIRST_DAY = "1900-01-01"
DAYS = (319, 229)  # 1900-01-01 to 2099-12-31 is 319 * 229 days


def _long(c: Column) -> Column:
    return c.cast("long")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _int(text: Column) -> Column:
    return text.try_cast("long")


def _luhn_sum(d: Column) -> Column:
    """Sum of the digits of d, the last counted once, every second one from it doubled."""

    def add(total: Column, i: Column) -> Column:
        x = F.substr(d, F.length(d) - i, F.lit(1)).cast("int")
        y = x * (1 + i % 2)
        return total + F.when(y > 9, y - 9).otherwise(y)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add)


def _bound(value: Column, fn) -> Column:
    """fn(value) with value computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _is_card(d: Column) -> Column:
    return F.length(d).between(13, 19) & (_luhn_sum(d) % 10 == 0)


def _cards_at(groups: Column) -> Column:
    """For each group of digits the number of groups of the card that starts there: 1 (undivided), 4 (4-4-4-4), 3 (4-6-5), 0 (none)."""

    def start(g: Column, i: Column) -> Column:
        long = lambda k: F.coalesce(F.length(F.get(groups, i + k)), F.lit(0))
        joined = lambda n: F.array_join(F.slice(groups, i + 1, F.lit(n)), "")
        four = (long(0) == 4) & g.rlike(ISSUER)
        return (
            F.when(long(0).between(13, 19) & g.rlike(ISSUER), F.when(_is_card(g), 1).otherwise(0))
            .when(four & (long(1) == 4) & (long(2) == 4) & (long(3) == 4), F.when(_is_card(joined(4)), 4).otherwise(0))
            .when(four & (long(1) == 6) & (long(2) == 5), F.when(_is_card(joined(3)), 3).otherwise(0))
            .otherwise(0)
        )

    return F.transform(groups, start)


def _cut(m: Column) -> Column:
    """A run of digit groups as pieces that are cards, other candidates, and what lies between; the first cards that don't overlap."""
    span = "struct<at:int,n:int>"

    def with_cards(groups: Column) -> Column:
        def chosen(counts: Column) -> Column:
            def take(s: Column, i: Column) -> Column:
                n = F.get(counts, i)
                here = (n > 0) & (i >= s["next"])
                one = F.array(F.struct(i.cast("int").alias("at"), n.cast("int").alias("n")))
                return F.struct(F.when(here, F.concat(s["out"], one)).otherwise(s["out"]).alias("out"), F.when(here, i + n).otherwise(s["next"]).alias("next"))

            zero = F.struct(F.expr(f"cast(array() as array<{span}>)").alias("out"), F.lit(0).alias("next"))
            return F.aggregate(F.sequence(F.lit(0), F.size(counts) - 1), zero, take, lambda s: s["out"])

        tokens = F.flatten(F.zip_with(groups, F.regexp_extract_all(m, F.lit("[ -]"), F.lit(0)), lambda a, b: F.array(a, F.coalesce(b, F.lit("")))))
        text = lambda ts, a, b: F.array_join(F.slice(ts, a + 1, F.greatest(b - a, F.lit(0))), "")

        def around(ts: Column, spans: Column) -> Column:
            def both(x: Column, j: Column) -> Column:
                before = F.when(j == 0, F.lit(0)).otherwise(2 * (F.get(spans, j - 1)["at"] + F.get(spans, j - 1)["n"]) - 1)
                return F.concat(_others(text(ts, before, 2 * x["at"])), F.array(text(ts, 2 * x["at"], 2 * (x["at"] + x["n"]) - 1)))

            last = F.element_at(spans, -1)
            return F.concat(F.flatten(F.transform(spans, both)), _others(text(ts, 2 * (last["at"] + last["n"]) - 1, F.size(ts))))

        return _bound(_cards_at(groups), lambda counts: _bound(chosen(counts), lambda spans: F.when(F.size(spans) == 0, _others(m)).otherwise(_bound(tokens, lambda ts: around(ts, spans)))))

    return _bound(F.split(m, "[ -]"), with_cards)


def _others(rest: Column) -> Column:
    """Text of a run outside its cards, cut at candidates of other forms; a rest of 13 to 19 digits may still be a card of no known issuer."""
    pattern = "|".join((DATE, SSN, PHONE))
    parts = F.zip_with(F.split(rest, pattern, -1), F.regexp_extract_all(rest, F.lit(pattern), F.lit(0)), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))
    return F.filter(F.flatten(parts), lambda x: x != "")


def _pieces(m: Column) -> Column:
    """A candidate as pieces that are candidates each; a run of digits that is no card as a whole is cut."""
    run = m.rlike("^[0-9][0-9 -]*$") & (F.length(_digits(m)) >= 13)
    return F.when(run & ~_is_card(_digits(m)), _cut(m)).otherwise(F.array(m))


def _form(m: Column) -> Column:
    """Digits and fields of a candidate and the first form that it has, valid or not."""
    d = _digits(m)
    forms = {"email": F.contains(m, F.lit("@")), "ip": m.rlike(f"^(?:{IP})$"), "date": m.rlike(f"^(?:{DATE})$"), "ssn": m.rlike(f"^(?:{SSN})$"), "phone": m.rlike(f"^(?:{PHONE})$")}
    form = F.coalesce(*[F.when(c, F.lit(k)) for k, c in forms.items()], F.lit("card"))
    parts = F.transform(F.split(m, "[-/.]"), lambda x: x.try_cast("int"))
    return F.struct(m.alias("m"), d.alias("d"), F.length(d).alias("n"), parts.alias("parts"), form.alias("form"))


def _dates(x: Column) -> Column:
    """The three readings of a date; null where there is no such day."""
    part = lambda i: F.get(x["parts"], F.lit(i))

    def day(y, mo, d):
        text = F.format_string("%04d-%02d-%02d", part(y), part(mo), part(d))
        return F.when((x["form"] == "date") & part(mo).between(1, 12) & part(d).between(1, 31), F.date_diff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")))

    year_first, dotted = x["m"].rlike("^[0-9]{4}"), F.contains(x["m"], F.lit("."))
    ymd, mdy, dmy = F.when(year_first, day(0, 1, 2)), F.when(~year_first & ~dotted, day(2, 0, 1)), F.when(~year_first, day(2, 1, 0))
    return F.struct(*[x[f].alias(f) for f in ("m", "d", "n", "parts", "form")], ymd.alias("ymd"), mdy.alias("mdy"), dmy.alias("dmy"))


def _valid(x: Column) -> Column:
    """The kind (null: not valid) and, of dates, the reading and the day."""
    octets_ok = F.forall(x["parts"], lambda v: v <= 255)
    area, group, serial = (F.substring(x["d"], *at).try_cast("long") for at in ((1, 3), (4, 2), (6, 4)))
    order = F.when(x["ymd"].isNotNull(), "ymd").when(x["mdy"].isNotNull(), "mdy").when(x["dmy"].isNotNull(), "dmy")
    days = F.coalesce(x["ymd"], x["mdy"], x["dmy"])
    ok = (
        F.when(x["form"] == "email", F.lit(True))
        .when(x["form"] == "ip", octets_ok)
        .when(x["form"] == "date", days.between(0, DAYS[0] * DAYS[1] - 1))
        .when(x["form"] == "ssn", area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0))
        .when(x["form"] == "phone", x["n"] <= 13)
        .otherwise(x["n"].between(13, 19) & (_luhn_sum(x["d"]) % 10 == 0))
    )
    return F.struct(*[x[f].alias(f) for f in ("m", "d", "n", "parts")], F.when(ok, x["form"]).alias("kind"), order.alias("order"), _long(days).alias("days"), F.floor((x["n"] - 2) / 2).cast("int").alias("half"))


def _parts(x: Column) -> Column:
    """The two parts l < a and r < b of the value, and the tweak."""
    d, n, half = x["d"], x["n"], x["half"]
    octet = lambda i: _long(F.get(x["parts"], F.lit(i)))
    area, group, serial = (F.substring(d, *at).try_cast("long") for at in ((1, 3), (4, 2), (6, 4)))
    # area codes from 200 on, as they are given out, stay among themselves
    phone_area = F.substring(d, -10, 3).try_cast("long")
    given = phone_area >= 200
    phone = (F.when(given, phone_area - 200).otherwise(phone_area), F.substring(d, -7, 7).try_cast("long"), F.when(given, 800).otherwise(200), F.lit(10**7), F.concat(F.substr(d, F.lit(1), n - 10), F.when(given, ":").otherwise(":0")))
    values = {
        "ip": (octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536), F.lit("")),
        "date": (F.floor(x["days"] / DAYS[1]), x["days"] % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), x["order"]),
        "ssn": (area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), F.lit("")),
        "phone": phone,
        "card": (F.substr(d, F.lit(2), half).try_cast("long"), F.substr(d, half + 2, n - 2 - half).try_cast("long"), F.pow(F.lit(10.0), half), F.pow(F.lit(10.0), n - 2 - half), F.concat(F.substring(d, 1, 1), n.cast("string"))),
    }

    def pick(i: int, to: str) -> Column:
        return F.coalesce(*[F.when(x["kind"] == k, v[i].cast(to)) for k, v in values.items()])

    return F.struct(*[x[f].alias(f) for f in ("m", "d", "n", "half", "kind")], *[pick(i, to).alias(name) for i, (name, to) in enumerate((("l", "long"), ("r", "long"), ("a", "long"), ("b", "long"), ("tweak", "string")))])


def _keyed(key: Column, kind: Column, tweak: Column, round_: Column, value: Column, size: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", key, kind, tweak, round_.cast("string"), value.cast("string")), 256)
    return _long(F.conv(F.substring(digest, 1, 14), 16, 10)) % size


def _permuted(x: Column, key: Column) -> Column:
    """x with l and r run through the network."""

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        grown = F.when(even, (s["l"] + _keyed(key, x["kind"], x["tweak"], i, s["r"], x["a"])) % x["a"]).otherwise(s["l"])
        other = F.when(even, s["r"]).otherwise((s["r"] + _keyed(key, x["kind"], x["tweak"], i, s["l"], x["b"])) % x["b"])
        return F.struct(grown.alias("l"), other.alias("r"))

    run = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(x["l"].alias("l"), x["r"].alias("r")), step)
    return F.struct(*[x[f].alias(f) for f in ("m", "d", "n", "half", "kind", "tweak")], F.when(x["l"].isNotNull(), run).alias("p"))


def _shifted(text: Column, stream: Column) -> Column:
    """Letters and digits of text moved within their class by the hex digits of stream."""

    def move(i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        k = F.conv(F.substr(stream, (i * 2 - 2) % 62 + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        turned = lambda low, n: F.char(F.lit(low) + (code - low + k) % n)
        return F.when(code.between(48, 57), turned(48, 10)).when(code.between(97, 122), turned(97, 26)).when(code.between(65, 90), turned(65, 26)).otherwise(c)

    return F.when(F.length(text) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), move), ""))


def _email(m: Column, key: Column) -> Column:
    """The local part as two halves of characters through the same kind of network; the domain stays."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    half = F.floor(F.length(local) / 2).cast("int")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        stream = F.sha2(F.concat_ws("|", key, F.lit("email"), i.cast("string"), F.when(even, s["r"]).otherwise(s["l"])), 256)
        return F.struct(F.when(even, _shifted(s["l"], stream)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(_shifted(s["r"], stream)).alias("r"))

    start = F.struct(F.substr(local, F.lit(1), half).alias("l"), F.substr(local, half + 1, F.length(local) - half).alias("r"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))
    return F.concat(done, F.lit("@"), domain)


def _filled(m: Column, digits: Column) -> Column:
    """m with its digits replaced in order."""

    def at(i: Column) -> Column:
        c = F.substr(m, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(m, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), at), "")


def _padded(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _new_digits(x: Column) -> Column:
    """The digits of the pseudonym (dates: the day; cards: without the check digit)."""
    n, half, l, r = x["n"], x["half"], x["p"]["l"], x["p"]["r"]
    ssn = F.concat(_padded(l + F.when(l >= 665, 2).otherwise(1), 3), _padded(F.floor(r / 9999) + 1, 2), _padded(r % 9999 + 1, 4))
    phone = F.concat(F.substr(x["d"], F.lit(1), n - 10), _padded(l + F.when(F.endswith(x["tweak"], F.lit(":0")), 0).otherwise(200), 3), _padded(r, 7))
    card = F.concat(F.substring(x["d"], 1, 1), _padded(l, half), _padded(r, n - 2 - half))
    digits = F.when(x["kind"] == "ssn", ssn).when(x["kind"] == "phone", phone).when(x["kind"] == "card", card)
    day = F.when(x["kind"] == "date", F.date_add(F.lit(FIRST_DAY).cast("date"), (l * DAYS[1] + r).cast("int")))
    return F.struct(*[x[f].alias(f) for f in ("m", "kind", "tweak", "p")], digits.alias("digits"), day.alias("day"))


def _rendered(x: Column, key: Column) -> Column:
    """The pseudonym in the form of x.m; x.m itself if it has no kind."""
    m, kind, l, r, digits = x["m"], x["kind"], x["p"]["l"], x["p"]["r"], x["digits"]
    ip = F.concat_ws(".", *[F.floor(v).cast("string") for v in (l / 256, l % 256, r / 256, r % 256)])
    check = (10 - _luhn_sum(F.concat(digits, F.lit("0"))) % 10) % 10
    sep = F.regexp_extract(m, "([-/.])", 1)
    wide = lambda v, i: F.when(F.length(F.element_at(F.split(m, "[-/.]"), i)) > 1, _padded(v, 2)).otherwise(v.cast("string"))
    y, mo, d = F.year(x["day"]).cast("string"), F.month(x["day"]), F.day(x["day"])
    date = F.when(x["tweak"] == "ymd", F.concat(y, sep, wide(mo, 2), sep, wide(d, 3))).when(x["tweak"] == "mdy", F.concat(wide(mo, 1), sep, wide(d, 2), sep, y)).otherwise(F.concat(wide(d, 1), sep, wide(mo, 2), sep, y))
    new = (
        F.when(kind == "email", _email(m, key))
        .when(kind == "ip", ip)
        .when(kind == "date", date)
        .when(kind.isin("ssn", "phone", "card"), _filled(m, F.concat(digits, F.when(kind == "card", check.cast("string")).otherwise(F.lit("")))))
        .otherwise(m)
    )
    return F.struct(kind.alias("kind"), m.alias("value"), new.alias("pseudonym"))


def _unary(step):
    return lambda x: step(x)


def pseudonymise(docs: DataFrame, key: str = DEMO_KEY) -> DataFrame:
    """docs with text pseudonymised, plus pii, an array of (kind, value, pseudonym) in text order.

    Null text stays null with an empty array.  Each row stands for itself; other
    columns stay as they are, a column named pii is replaced.
    """
    k = F.lit(key)
    docs = docs.drop("pii")
    found = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    # the pieces are read twice: as a column of their own they are made once
    docs = docs.withColumn("pii", F.transform(found, _pieces))
    # what lies before each piece: the text between candidates, nothing inside a candidate
    gaps = F.zip_with(F.split("text", PATTERN, -1), F.col("pii"), lambda gap, ps: F.transform(F.coalesce(ps, F.array(F.lit(""))), lambda p, i: F.when(i == 0, gap).otherwise("")))
    done = F.flatten("pii")
    # small steps, each over the fields of the one before, keep the expressions small
    for step in (_form, _dates, _valid, _parts, lambda x: _permuted(x, k), _new_digits, lambda x: _rendered(x, k)):
        done = F.transform(done, _unary(step))
    # columns again, not fields of one, so that they too are made once
    between = "between"
    while between in docs.columns:
        between += "_"
    named = docs.withColumns({"pii": done, between: F.when(F.size("pii") > 0, F.flatten(gaps))})
    put = F.array_join(F.zip_with(between, "pii", lambda a, b: F.concat(a, F.coalesce(b["pseudonym"], F.lit("")))), "")
    named = named.withColumn("text", F.when(F.size("pii") > 0, put).otherwise(F.col("text"))).drop(between)
    none = F.filter("pii", lambda x: x["kind"].isNotNull())
    return named.withColumn("pii", F.coalesce(none, F.expr("cast(array() as array<struct<kind:string,value:string,pseudonym:string>>)")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    kinds = F.transform("pii", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.size("pii").cast("long").alias("n_pii"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")
