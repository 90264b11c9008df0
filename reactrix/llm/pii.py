"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Validated values (payment cards by check digit, IPv4 addresses by range, phone and social security numbers by form, dates by calendar)
go through a keyed Feistel permutation of their own format's domain: digits stay digits, separators stay, cards stay
valid by check digit, dates stay dates. A permutation is one to one and has no memory, so equal values in any two
documents get equal pseudonyms, different values get different ones, and nothing is joined or collected. The local parts of
e-mail addresses go through a Feistel network on their letters and digits.

Patterns repeat single characters only (or groups at most 14 times): Java's matcher recurses at each turn of a repeated group, so that one
long run of text would end the executor.

Defined results: null text stays null; empty texts and texts without a valid value stay as they are; a value that fails its validation stays, but valid values among
its digit groups go; e-mail addresses have a local part of up to 64 characters and a domain of up to 255 (labels that aren't empty), longer ones stay; day and month are read in
that order where both orders are valid; dates outside 1800-2199 stay; very long texts are read whole; where two forms start at one place the first in FORMS wins; repeated
rows get equal results; extra columns are left out; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_of, let

# Forms of the kinds, in the order in which they are tried.
FORMS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "date": r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4}",
    "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": r"(?:\+\d{1,3} ?)?\(\d{3}\) ?\d{3}-\d{4}|\+[1-9](?:[ .-]?\d){7,14}(?![-./@][A-Za-z0-9])"
             r"|(?:1[ .-])?(?:\d{3}-\d{3}-|\d{3}\.\d{3}\.|[2-9]\d{2} [2-9]\d{2} )\d{4}(?!-?[0-9])|0[1-9](?:(?: \d{2}){4}|(?:\.\d{2}){4}|(?:-\d{2}){4})(?![ .-]?[0-9])",
    "card": r"\d(?:[ -]?\d){12,18}",
}
KINDS = list(FORMS)
#: Digit groups behind each other, in which cards and other values are looked for; it leaves a group that goes on otherwise to what follows.
RUN = r"\d[0-9 -]{11,}\d(?![./@%+_][A-Za-z0-9])"
#: No letter or digit may touch a value.
ANY = r"(?<![A-Za-z0-9._%+-])(?:" + "|".join(f"(?:{FORMS[k]})(?![A-Za-z0-9])" for k in FORMS if k != "card") + f"|{RUN})(?![A-Za-z0-9])"
#: Digit groups that a card may have.
GROUPS = 19
#: Days of a 400-year calendar cycle, as the product that the date network needs.
DATE_LEFT, DATE_RIGHT = 189, 773
ROUNDS = 8


def keyed(key: str, kind: Column, turn, half) -> Column:
    """60 keyed pseudo-random bits of a half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), kind, turn.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("bigint")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: Column) -> Column:
    """(l, r): keyed permutation of pairs below (a, b), by alternating modular additions."""
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def turn(s, i):
        return F.when(i % 2 == 0, F.struct(F.pmod(s["l"] + F.pmod(keyed(key, kind, i, s["r"]), a), a).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(keyed(key, kind, i, s["l"]), b), b).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Digits of up to 36 places to as many digits. The length is part of the key, so numbers of another length tell nothing of these."""
    n = F.length(digits)
    kind = F.concat(F.lit(kind), n.cast("string"))
    half = F.floor(n / 2).cast("int")
    a, b = F.pow(F.lit(10.0), half).cast("bigint"), F.pow(F.lit(10.0), n - half).cast("bigint")
    out = feistel(F.substring(digits, F.lit(1), half).try_cast("bigint"), F.substring(digits, half + 1, n - half).try_cast("bigint"), a, b, key, kind)
    return let(F.struct(out.alias("o"), half.alias("h"), (n - half).alias("k")), lambda s: F.concat(F.lpad(s["o"]["l"].cast("string"), s["h"], F.lit("0")), F.lpad(s["o"]["r"].cast("string"), s["k"], F.lit("0"))))


def luhn_sum(digits: Column, odd: int) -> Column:
    """Sum of the digits, those at odd (or even) places from the right doubled; by counts of each digit, as it is asked for often."""
    back = F.reverse(digits)
    evens, odds = F.regexp_replace(back, "([0-9]).?", "$1"), F.regexp_replace(back, "[0-9](.?)", "$1")
    plain, doubled = (evens, odds) if odd else (odds, evens)
    return let(F.concat(plain, F.translate(doubled, "0123456789", "0246813579")), lambda s: sum((k * (F.length(s) - F.length(F.replace(s, F.lit(str(k)), F.lit("")))) for k in range(1, 10)), F.lit(0)))


def refill(form: Column, digits: Column) -> Column:
    """The form with its digits replaced in order."""
    chars = F.split(form, "")
    return let(F.struct(chars.alias("c"), digits.alias("d"), form.alias("f")), lambda s: F.array_join(F.transform(s["c"], lambda c, i: F.when(
        c.rlike("[0-9]"), F.substring(s["d"], F.length(F.regexp_replace(F.substring(s["f"], F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)), ""))


def only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def shifted(part: Column, half: Column, key: str, turn: int) -> Column:
    """Letters and digits of part moved on in their alphabets by a key stream of the other half."""
    stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(f"email{turn}"), half), 256)

    def moved(c, k):
        def cycle(first, n):
            return F.char((F.lit(first) + (F.ascii(c) - first + k) % n).cast("int"))

        return F.when(c.rlike("[a-z]"), cycle(97, 26)).when(c.rlike("[A-Z]"), cycle(65, 26)).when(c.rlike("[0-9]"), cycle(48, 10)).otherwise(c)

    return let(F.struct(part.alias("p"), stream.alias("s")), lambda s: F.array_join(F.transform(F.split(s["p"], ""), lambda c, i: moved(c, F.conv(F.substring(s["s"], (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int"))), ""))


def pseudonym(value: Column, key: str) -> Column:
    """(kind, text) of one match; kind is null if it isn't valid."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    half = F.greatest(F.lit(1), F.floor(F.length(local) / 2).cast("int"))

    def email(s):
        left, right = s["l"], s["r"]
        for turn in range(2):
            left, right = shifted(left, right, key, 2 * turn), right
            right = shifted(right, left, key, 2 * turn + 1)
        return F.concat(left, right)

    mail = F.concat(let(F.struct(F.substring(local, F.lit(1), half).alias("l"), F.substring(local, half + 1, F.length(local)).alias("r")), email), F.lit("@"), domain)

    day = day_of(value)
    days = F.datediff(day, F.lit("1800-01-01").cast("date")).cast("bigint")
    month_first = ~value.rlike(r"^\d{4}") & in_order(value, 3, 2, 1).isNull()

    def moved(x):
        return let(feistel(F.floor(x / DATE_RIGHT), x % DATE_RIGHT, F.lit(DATE_LEFT), F.lit(DATE_RIGHT), key, F.lit("date")), lambda o: (o["l"] * DATE_RIGHT + o["r"]).cast("bigint"))

    def as_date(x):
        return F.date_add(F.lit("1800-01-01").cast("date"), x.cast("int"))

    # a date that only month first makes valid goes on to one that is so too, or it could meet the pseudonym of a day-first date
    def walk(first):
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), moved(days), lambda x, i: F.when(first & (F.dayofmonth(as_date(x)) <= 12), moved(x)).otherwise(x))

    walked = F.when(month_first, let(F.lit(True), walk)).otherwise(moved(days))
    form = F.when(value.rlike(r"^\d{4}"), "yMd").when(month_first, "Mdy").otherwise("dMy")
    date = let(as_date(walked), lambda d: F.replace(F.when(form == "yMd", F.date_format(d, "yyyy-MM-dd")).when(form == "Mdy", F.date_format(d, "MM-dd-yyyy")).otherwise(F.date_format(d, "dd-MM-yyyy")), F.lit("-"), F.regexp_extract(value, "[-/.]", 0)))

    octets = F.transform(F.split(value, r"\."), lambda x: x.try_cast("int"))
    ip = let(feistel(F.get(octets, F.lit(0)) * 256 + F.get(octets, F.lit(1)), F.get(octets, F.lit(2)) * 256 + F.get(octets, F.lit(3)), F.lit(65536), F.lit(65536), key, F.lit("ip")), lambda o: F.concat_ws(".", F.floor(o["l"] / 256), o["l"] % 256, F.floor(o["r"] / 256), o["r"] % 256))

    def whole(kind):
        return refill(value, permuted_digits(only_digits(value), key, kind))

    # what stays: a country code before brackets, a leading 1 of ten digits, or the first digit of another international number
    kept = F.regexp_extract(value, r"^(?:[^(]*(?=\()|\+?1[ .-]?(?=\d{3}[ .-]?\d{3}[ .-]?\d{4}$)|\+\d|)", 0)
    tail = F.substring(value, F.length(kept) + 1, F.length(value))
    phone = F.concat(kept, refill(tail, permuted_digits(only_digits(tail), key, "phone")))
    number = only_digits(value)
    payload = permuted_digits(F.substring(number, F.lit(1), F.length(number) - 1), key, "card")
    card = refill(value, let(payload, lambda p: F.concat(p, ((10 - luhn_sum(p, 0) % 10) % 10).cast("string"))))

    def result(kind, text):
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    kind = kind_of(value)
    texts = {"email": mail, "date": date, "ip": ip, "ssn": whole("ssn"), "phone": phone, "card": card}
    return let(kind, lambda found: F.struct(found.alias("kind"), F.coalesce(*[F.when(found == k, texts[k]) for k in KINDS], value).alias("text")))


def in_order(value: Column, year: int, month: int, day: int) -> Column:
    """The date of the value's numbers in that order, null if there is no such day."""
    number = F.regexp_extract_all(value, F.lit(r"\d+"), F.lit(0))
    return let(number, lambda n: F.try_to_date(F.concat_ws("-", F.get(n, F.lit(year - 1)), F.lpad(F.get(n, F.lit(month - 1)), 2, "0"), F.lpad(F.get(n, F.lit(day - 1)), 2, "0")), "yyyy-MM-dd"))


def day_of(value: Column) -> Column:
    """Year first by its four digits; else the day is first, or the month where the day can't be."""
    return F.when(value.rlike(r"^\d{4}"), in_order(value, 1, 2, 3)).otherwise(F.coalesce(in_order(value, 3, 2, 1), in_order(value, 3, 1, 2)))


def kind_of(value: Column) -> Column:
    """The kind whose form and validation the whole value meets, or null."""
    def is_form(kind):
        return value.rlike("^(?:" + FORMS[kind] + ")$")

    return (
        F.when(is_form("email") & (F.length(F.substring_index(value, "@", 1)) <= 64) & (F.length(F.substring_index(value, "@", -1)) <= 255) & ~F.contains(F.substring_index(value, "@", -1), F.lit("..")), "email")
        .when(is_form("date") & F.coalesce(F.year(day_of(value)).between(1800, 2199), F.lit(False)), "date")
        .when(is_form("ip") & F.forall(F.split(value, r"\."), lambda x: x.try_cast("int") <= 255), "ip")
        .when(is_form("ssn"), "ssn")
        .when(is_form("phone"), "phone")
        .when(is_form("card") & (luhn_sum(only_digits(value), 1) % 10 == 0), "card")
    )


#: What can be a value among digit groups; a cheap test before the validation.
GROUPED = "^(?:" + "|".join(FORMS[k] for k in ("date", "ssn", "phone", "card")) + ")$"


def inside(run: Column) -> Column:
    """Pieces of digit groups behind each other: from each group on, the longest value that ends with a group and is valid, and what is between.

    First every group finds its longest value by itself; then a walk over the lengths alone keeps those that don't begin inside an earlier one.
    """
    groups = F.regexp_extract_all(run, F.lit(r"\d+[ -]*"), F.lit(0))

    def joined(g, start, k):
        return F.array_join(F.slice(g, start + 1, k), "")

    def longest(g, i):
        def valid(k):
            return let(F.regexp_replace(joined(g, i, k), "[ -]+$", ""), lambda v: (F.length(v) >= 8) & (F.length(v) <= 40) & v.rlike(GROUPED) & kind_of(v).isNotNull())

        return F.coalesce(F.get(F.filter(F.sequence(F.least(F.lit(GROUPS), F.size(g) - i), F.lit(1), F.lit(-1)), valid), F.lit(0)), F.lit(0))

    def chosen(g):
        at = F.transform(g, lambda _, i: longest(g, i))
        return let(F.struct(g.alias("g"), taken_from(at).alias("k")), lambda s: F.flatten(F.transform(s["g"], lambda x, i: piece(s["g"], s["k"], x, i))))

    def piece(g, k, x, i):
        """What group i adds: a value that begins here and the separators behind it, the group as it is, or nothing inside a value."""
        value = F.regexp_replace(joined(g, i, F.get(k, i)), "[ -]+$", "")
        ending = F.regexp_extract(F.get(g, i + F.get(k, i) - 1), "[ -]*$", 0)
        return F.when(F.get(k, i) > 0, F.array(value, ending)).when(F.get(k, i) == 0, F.array(x)).otherwise(F.expr("cast(array() as array<string>)"))

    return let(groups, chosen)


def taken_from(longest: Column, width: int = 256) -> Column:
    """For each group the length of the value taken there, 0 for none, -1 inside a taken value; longest: of the values that begin at each group.

    In pieces of ``width``, as an array that grows by one is copied at each step.
    """
    def step(s, k):
        now = F.when(s["left"] > 0, F.lit(-1)).otherwise(k)
        return F.struct(F.when(s["left"] > 0, s["left"] - 1).otherwise(F.greatest(k - 1, F.lit(0))).alias("left"), F.concat(s["out"], F.array(now)).alias("out"))

    def chunk(s, part):
        return let(F.aggregate(part, F.struct(s["left"].alias("left"), F.expr("cast(array() as array<int>)").alias("out")), step), lambda t: F.struct(t["left"].alias("left"), F.concat(s["all"], F.array(t["out"])).alias("all")))

    def cut(k):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(k) - 1) / width).cast("int")), lambda j: F.slice(k, j * width + 1, F.lit(width)))

    start = F.struct(F.lit(0).alias("left"), F.expr("cast(array() as array<array<int>>)").alias("all"))
    return F.aggregate(let(longest, cut), start, chunk, lambda s: F.flatten(s["all"]))


def pieces(value: Column, key: str) -> Column:
    """(kind, text) of the pieces of one match: of the whole, or of what is inside digit groups that aren't one valid value."""
    split = F.when(value.rlike("^[0-9 -]{13,}$") & kind_of(value).isNull(), inside(value)).otherwise(F.array(value))
    return F.transform(split, lambda v: pseudonym(v, key))


def same_kind(kind: str):
    return lambda x: x["kind"] == kind


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (pseudonymous), n_<kind> of each kind: one row for each input row."""
    def parts(text):
        return F.struct(F.split(text, ANY, -1).alias("gaps"), F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: pieces(m, key)).alias("found"))

    none = F.struct(F.array(F.col("text")).alias("gaps"), F.expr("cast(array() as array<array<struct<kind:string,text:string>>>)").alias("found"))
    rows = clean_of(docs, "doc_id", "text").withColumn("p", F.when(F.col("text").rlike(r"[0-9]|@") & F.col("text").rlike(ANY), let(F.col("text"), parts)).otherwise(none))
    ends = F.transform("p.found", lambda x: F.array_join(F.transform(x, lambda y: y["text"]), ""))
    text = F.array_join(F.flatten(F.zip_with(F.col("p.gaps"), F.concat(ends, F.array(F.lit(""))), lambda g, e: F.array(g, e))), "")
    return rows.select("doc_id", F.when(F.size("p.found") == 0, F.col("text")).otherwise(text).alias("text"), *[F.size(F.filter(F.flatten("p.found"), same_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS])
