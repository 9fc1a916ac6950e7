"""PII (9), native: format-preserving Feistel pseudonyms.

One pattern finds candidates in a text; each is validated (checksum, calendar, ranges), permuted within its format under
a key, and put back in place. The permutation of a kind is an alternating Feistel network over a domain written as a
product a * b: rounds add a keyed hash of one half to the other, modulo its size, so it is a bijection of the valid
values, equal values get equal pseudonyms in all documents, and the holder of the key can invert it (``restore``).

    card     13 to 19 digits with a Luhn check; the first digit and the separators stay, the check digit is made anew
    phone    North American numbers with area and exchange 200 to 999, and any ten digits written with a + or the area in
             brackets, those below 200 among themselves; punctuation stays
    ssn      ddd-dd-dddd with area 001 to 899 but 666, group and serial above 0
    ipv4     four octets of 0 to 255
    date     a calendar date of 1700 to 2099 as yyyy-mm-dd, yyyy/mm/dd, d.m.yyyy or m/d/yyyy, with its zero padding
    email    letters and digits of the local part, each within its class, by a Feistel network over its two halves; the
             domain stays

What fails its validation (a version number, a 16-digit order number) stays as it is. Texts without a digit that could
start a candidate cost one scan. Everything is an expression on the row: no shuffle and no state.

Defined results: a null text stays null with counts of 0; an empty text stays empty; repeated rows get equal results; an
empty table has no rows; of overlapping candidates the first from the left counts. Pseudonyms are permutations and not
erasure: who holds the key can undo them, and a network may map a value to itself with the chance of one in its domain.
``restore`` gives back every value; what its writing had beyond the value is lost: leading zeros of an octet, and whether
a day or month of d.m.yyyy and m/d/yyyy was padded. There is no default key; an empty one is refused.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Params:
    key: str
    rounds: int = 8
    #: Undo the permutations instead of applying them.
    inverse: bool = False

    def __post_init__(self) -> None:
        if not self.key:
            raise ValueError("pseudonyms need a secret key")
        if self.rounds < 4:
            raise ValueError("fewer than 4 rounds do not mix both halves")

    def turns(self) -> Column:
        """The rounds in the order in which they are made or undone."""
        return F.sequence(F.lit(self.rounds - 1), F.lit(0), F.lit(-1)) if self.inverse else F.sequence(F.lit(0), F.lit(self.rounds - 1))

    def moved(self, value: Column, by: Column, size: Column) -> Column:
        return F.pmod(value - by if self.inverse else value + by, size)


#: Candidates in order of precedence; possessive quantifiers keep the scan linear.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}+@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}\.)++[A-Za-z]{2,24}",
    "ipv4": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d.]*\d)",
    "date": r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?!\d|[./\-]\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?!\d|-\d)",
    "phone": r"(?:\+?1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)|\+1\d{10}(?!\d)",
    "card": r"(?:\d{4}[ \-]){3}\d{4}(?!\d)|\d{4}[ \-]\d{6}[ \-]\d{5}(?!\d)|\d{13,19}(?!\d)",
}
_EDGE = r"(?<![A-Za-z0-9._%+\-])"
ANY = _EDGE + "(?:" + "|".join(PATTERNS.values()) + ")"
KINDS = list(PATTERNS)


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _number(s: Column) -> Column:
    return s.cast("bigint")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, kind: str, params: Params) -> Column:
    """A struct (a, b): the keyed permutation of range(size_a) x range(size_b)."""
    def add(value: Column, other: Column, size: Column, i: Column) -> Column:
        said = F.concat_ws("|", F.lit(params.key), F.lit(kind), size_a.cast("string"), size_b.cast("string"), i.cast("string"), other.cast("string"))
        return params.moved(value, F.pmod(F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("bigint"), size), size)

    def step(acc: Column, i: Column) -> Column:
        left = F.struct(add(acc["a"], acc["b"], size_a, i).alias("a"), acc["b"].alias("b"))
        right = F.struct(acc["a"].alias("a"), add(acc["b"], acc["a"], size_b, i).alias("b"))
        return F.when(i % 2 == 0, left).otherwise(right)

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(params.turns(), start, step)


def _fill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by those of ``digits``."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("at"))
    step = lambda acc, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(acc["s"], F.substring(digits, acc["at"], F.lit(1))).alias("s"), (acc["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["at"].alias("at")))
    return F.aggregate(F.split(shape, ""), start, step, lambda acc: acc["s"])


def _luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """The Luhn sum from the right; ``doubled_first``: the last digit is doubled already."""
    turn = 0 if doubled_first else 1
    value = lambda c, i: F.when(i % 2 == turn, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda acc, v: acc + v)


def _pad(n: Column, width) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _card(m: Column, p: Params) -> Column:
    def of(d: Column) -> Column:
        middle = F.length(d) - 2  # without the first and the check digit
        half = F.floor(middle / 2).cast("int")
        power = lambda n: F.pow(F.lit(10), n).cast("bigint")
        rest = middle - half
        mixed = feistel(_number(F.substring(d, F.lit(2), half)), _number(F.substring(d, half + 2, rest)), power(half), power(rest), "card", p)

        def made(x: Column) -> Column:
            body = F.concat(F.substring(d, 1, 1), _pad(x["a"], half), _pad(x["b"], rest))
            return _fill(m, F.concat(body, F.pmod(10 - F.pmod(_luhn_sum(body, True), F.lit(10)), F.lit(10)).cast("string")))

        return F.when((_luhn_sum(d, False) % 10 == 0) & d.rlike("[1-9]"), let(mixed, made))

    return let(_digits(m), of)


def _phone(m: Column, p: Params) -> Column:
    def of(d: Column) -> Column:
        ten = F.substring(d, F.length(d) - 9, F.lit(10))

        def build(t: Column) -> Column:
            area, exchange = _number(F.substring(t, 1, 3)), _number(F.substring(t, 4, 3))
            last = exchange * 10000 + _number(F.substring(t, 7, 4))

            def within(low_a: int, size_a: int, low_b: int, size_b: int, kind: str) -> Column:
                mixed = feistel(area - low_a, last - low_b, F.lit(size_a).cast("bigint"), F.lit(size_b).cast("bigint"), kind, p)
                made = lambda x: F.concat(F.substring(d, F.lit(1), F.length(d) - 10), _pad(x["a"] + low_a, 3), _pad(x["b"] + low_b, 7))
                return _fill(m, let(mixed, made))

            written = m.startswith("+") | m.contains("(")
            valid = F.when((area >= 200) & (exchange >= 200), within(200, 800, 2_000_000, 8_000_000, "phone"))
            return valid.when(written & (area < 200), within(0, 200, 0, 10_000_000, "phone area")).when(written, within(200, 800, 0, 2_000_000, "phone exchange"))

        return let(ten, build)

    return let(_digits(m), of)


def _ssn(m: Column, p: Params) -> Column:
    area, group, serial = (_number(F.substring(m, *x)) for x in ((1, 3), (5, 2), (8, 4)))
    index = area - F.when(area > 666, 2).otherwise(1)
    mixed = feistel(index, (group - 1) * 9999 + serial - 1, F.lit(898).cast("bigint"), F.lit(99 * 9999).cast("bigint"), "ssn", p)
    made = lambda x: F.concat_ws("-", _pad(x["a"] + F.when(x["a"] >= 665, 2).otherwise(1), 3), _pad(F.floor(x["b"] / 9999) + 1, 2), _pad(F.pmod(x["b"], F.lit(9999).cast("bigint")) + 1, 4))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), let(mixed, made))


def _ipv4(m: Column, p: Params) -> Column:
    def of(o: Column) -> Column:
        at = lambda k: F.get(o, F.lit(k)).cast("bigint")
        half = F.lit(65536).cast("bigint")
        mixed = feistel(at(0) * 256 + at(1), at(2) * 256 + at(3), half, half, "ipv4", p)
        octet = lambda v: F.concat_ws(".", F.floor(v / 256).cast("string"), F.pmod(v, F.lit(256).cast("bigint")).cast("string"))
        return F.when((at(0) < 256) & (at(1) < 256) & (at(2) < 256) & (at(3) < 256), let(mixed, lambda x: F.concat_ws(".", octet(x["a"]), octet(x["b"]))))

    return let(F.split(m, r"\."), of)


DAY_ZERO = -98615  # 1700-01-01 in days from 1970-01-01


def _date(m: Column, p: Params) -> Column:
    """The 146097 days of 1700 to 2099 are 189 * 773."""
    def of(o: Column) -> Column:
        at = lambda k: F.get(o, F.lit(k))
        year_first, dotted = m.rlike(r"^\d{4}"), m.contains(".")
        year = F.when(year_first, at(0)).otherwise(at(2))
        month = F.when(year_first | dotted, at(1)).otherwise(at(0))
        day = F.when(year_first, at(2)).when(dotted, at(0)).otherwise(at(1))
        value = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
        n = F.unix_date(value).cast("bigint") - DAY_ZERO

        def made(x: Column) -> Column:
            def written(d: Column) -> Column:
                sep = F.regexp_extract(m, r"([./\-])", 1)
                like = lambda part, number: F.when(F.length(part) == 2, _pad(number, 2)).otherwise(number.cast("string"))
                y = _pad(F.year(d), 4)
                return F.when(year_first, F.concat(y, sep, _pad(F.month(d), 2), sep, _pad(F.day(d), 2))) \
                    .when(dotted, F.concat(like(at(0), F.day(d)), sep, like(at(1), F.month(d)), sep, y)) \
                    .otherwise(F.concat(like(at(0), F.month(d)), sep, like(at(1), F.day(d)), sep, y))

            return let(F.date_from_unix_date((x["a"] * 773 + x["b"] + DAY_ZERO).cast("int")), written)

        mixed = feistel(F.floor(n / 773), F.pmod(n, F.lit(773).cast("bigint")), F.lit(189).cast("bigint"), F.lit(773).cast("bigint"), "date", p)
        return F.when(n.between(0, 146096), let(mixed, made))

    return let(F.split(m, r"[./\-]"), of)


def _shift(own: Column, other: Column, i: Column, p: Params) -> Column:
    """``own`` with each letter and digit moved within its class by a keyed hash of ``other``."""
    def moved(c: Column, k: Column) -> Column:
        said = F.concat_ws("|", F.lit(p.key), F.lit("email"), i.cast("string"), k.cast("string"), other)
        by = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("bigint")
        turn = lambda zero, n: F.char(p.moved(F.ascii(c) - ord(zero), F.pmod(by, F.lit(n).cast("bigint")), F.lit(n).cast("bigint")) + ord(zero))
        return F.when(c.rlike("[a-z]"), turn("a", 26)).when(c.rlike("[A-Z]"), turn("A", 26)).when(c.rlike("[0-9]"), turn("0", 10)).otherwise(c)

    return F.array_join(F.transform(F.split(own, ""), moved), "")


def _email(m: Column, p: Params) -> Column:
    def of(local: Column) -> Column:
        half = F.floor(F.length(local) / 2).cast("int")

        def step(acc: Column, i: Column) -> Column:
            left = F.struct(_shift(acc["a"], acc["b"], i, p).alias("a"), acc["b"].alias("b"))
            right = F.struct(acc["a"].alias("a"), _shift(acc["b"], acc["a"], i, p).alias("b"))
            return F.when(i % 2 == 0, left).otherwise(right)

        start = F.struct(F.substring(local, F.lit(1), half).alias("a"), F.substring(local, half + 1, F.length(local)).alias("b"))
        return F.aggregate(p.turns(), start, step, lambda acc: F.concat(acc["a"], acc["b"], F.substring(m, F.length(local) + 1, F.length(m))))

    return let(F.substring_index(m, "@", 1), of)


MAKERS = {"email": _email, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(m: Column, params: Params) -> Column:
    """(kind, value) of a candidate; both null where no kind is valid."""
    def tried(kinds: list[str]) -> Column:
        if not kinds:
            return F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"))
        kind = kinds[0]
        made = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), MAKERS[kind](m, params))
        return let(made, lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value"))).otherwise(tried(kinds[1:])))

    return tried(KINDS)


def pseudonymise(docs: DataFrame, params: Params, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, n_replaced, and n_<kind> for each kind."""
    t = docs[text].cast("string")
    found = F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
    rows = docs.select(docs[id_column].alias("doc_id"), t.alias("_t"), found.alias("_found"))

    def whole(made: Column) -> Column:
        def joined(gaps: Column) -> Column:
            piece = lambda g, i: F.concat(g, F.coalesce(F.get(made, i)["value"], F.get(F.col("_found"), i), F.lit("")))
            return F.array_join(F.transform(gaps, piece), "")

        count = lambda kind: F.size(F.filter(made, lambda x: x["kind"] == kind)).cast("bigint").alias(kind)
        return F.struct(let(F.split(F.col("_t"), ANY, -1), joined).alias("text"), *[count(k) for k in KINDS])

    some = F.size("_found") > 0
    done = F.when(some, let(F.transform(F.col("_found"), lambda m: pseudonym(m, params)), whole))
    rows = rows.select("doc_id", "_t", done.alias("_done"))
    counts = [F.coalesce(F.col("_done")[k], F.lit(0).cast("bigint")) for k in KINDS]
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return rows.select("doc_id", F.coalesce(F.col("_done.text"), F.col("_t")).alias("text"), total.alias("n_replaced"), *[c.alias(f"n_{k}") for c, k in zip(counts, KINDS)])


def restore(docs: DataFrame, params: Params, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The documents that ``pseudonymise`` was given, by the key it was given; the same columns."""
    return pseudonymise(docs, replace(params, inverse=True), text, id_column)


#: The session setting with the secret key. Where it is unset the query takes a public one, which hides nothing: the
#: tables here are synthetic.
KEY_SETTING, PUBLIC_KEY = "spark.provenant.pii.key", "public key of the synthetic tables"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), Params(spark.conf.get(KEY_SETTING, PUBLIC_KEY)))


QUERIES = {"op9_pii": op9_pii}
SQL: dict[str, str] = {}
