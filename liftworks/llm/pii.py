"""Personal data replaced by format-preserving pseudonyms.

Account numbers, phone numbers, social numbers, IPv4 addresses and dates are found by pattern, validated (mod-10 check digit, ranges
of a social number's parts, octets, calendar) and permuted by a keyed Feistel network within their own format: digits stay digits at
their places, a valid number stays valid, an address stays an address, a date a date of the same layout. The permutation is a
bijection of the valid values, so equal values stay linked across documents and `restore` gives them back under the key. E-mail
local parts and long hexadecimal secrets get a keyed digest of the same kind (not invertible). DataFrame functions only.

Defined cases: a null text stays null, an empty one empty; what fails its validation is no finding and stays as it is (phone numbers
have no check of their own, only their layout); texts without a finding stay untouched; very long texts are rewritten whole; repeated
rows alike; other columns are kept. Not found: dates as day/month/year or in words, IPv6.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftworks.llm.common import table

#: The session setting that holds the key, and the key where it is unset (for tests: it keeps nothing secret).
KEY_SETTING, KEY, ROUNDS = "spark.liftworks.pseudonym.key", "pseudonym-key-1", 8
#: Patterns of what is looked for, in order of precedence.
PATTERNS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "date": r"(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "slashed": r"(?<![0-9/])(?:19|20)[0-9]{2}/[0-9]{2}/[0-9]{2}(?![0-9/])",
    "dotted": r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "abroad": r"\+[0-9]{1,3}(?:[ .-][0-9]{2,5}){2,5}(?![0-9])",
    "social": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
#: What every finding of every kind holds: a digit, an @, or (secrets of letters alone) as many hexadecimal letters as the shortest secret has.
LIKELY = "[0-9@]|[a-fA-F]{32}"
#: Layouts of dates by pattern.
LAYOUTS = {"date": "yyyy-MM-dd", "slashed": "yyyy/MM/dd", "dotted": "dd.MM.yyyy"}
#: Dates are permuted among the 17 x 4297 = 73,049 days from 1900-01-01 to 2099-12-31.
DAY_0, DAYS = "1900-01-01", (17, 4297)
#: Social numbers are permuted among the 898 x (99 x 9999) with area 001-665 or 667-899, group 01-99 and serial 0001-9999.
AREAS, SERIALS = 898, 9999


class Cipher:
    """The permutations under one key, forwards or (inverse) backwards."""

    def __init__(self, key: str, inverse: bool = False):
        self.key, self.inverse = key, inverse

    def feistel(self, left: Column, right: Column, a: Column, b: Column, tweak: str) -> Column:
        """Struct (l, r) of a keyed permutation of (left mod a, right mod b): alternating rounds add a keyed hash of the other half."""

        def f(i: Column, other: Column, m: Column) -> Column:
            h = F.sha2(F.concat_ws("|", F.lit(f"{self.key}|{tweak}"), a.cast("string"), b.cast("string"), i.cast("string"), other.cast("string")).cast("binary"), 256)
            return F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("long"), m)

        sign = -1 if self.inverse else 1
        rounds = range(ROUNDS - 1, -1, -1) if self.inverse else range(ROUNDS)

        def step(s: Column, i: Column) -> Column:
            even = i % 2 == 0
            return F.struct(
                F.when(even, F.pmod(s["l"] + sign * f(i, s["r"], a), a)).otherwise(s["l"]).alias("l"),
                F.when(even, s["r"]).otherwise(F.pmod(s["r"] + sign * f(i, s["l"], b), b)).alias("r"),
            )

        return F.aggregate(F.array(*[F.lit(i) for i in rounds]), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)

    def digits(self, digits: Column, tweak: str) -> Column:
        """A permutation of the digit strings of this length (2 to 36 digits)."""
        n = F.length(digits)
        half = F.floor(n / 2).cast("int")
        rest = (n - half).cast("int")
        ten = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
        moved = self.feistel(F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, rest), ten(half), ten(rest), tweak)
        return _using(moved, lambda s: F.concat(F.lpad(s["l"].cast("string"), half, "0"), F.lpad(s["r"].cast("string"), rest, "0")))

    def account(self, digits: Column) -> Column:
        """The digits before the last are permuted; the last one is their check digit again."""
        return _using(self.digits(F.substring(digits, F.lit(1), F.length(digits) - 1), "account"), lambda new: F.concat(new, luhn(new).cast("string")))

    def social(self, token: Column) -> Column:
        area, group, serial = _social(token)
        at = self.feistel(area - 1 - (area > 666).cast("int"), (group - 1) * SERIALS + serial - 1, _long(AREAS), _long(99 * SERIALS), "social")
        first = lambda s: s["l"] + 1 + (s["l"] >= 665).cast("int")
        return _using(at, lambda s: F.format_string("%03d-%02d-%04d", first(s), F.floor(s["r"] / SERIALS) + 1, F.pmod(s["r"], F.lit(SERIALS)) + 1))

    def address(self, token: Column) -> Column:
        pair = lambda i: F.element_at(_octets(token), i) * 256 + F.element_at(_octets(token), i + 1)
        at = self.feistel(pair(1), pair(3), _long(65536), _long(65536), "ip")
        return _using(at, lambda s: F.concat_ws(".", *[F.floor(s[h] / 256).cast("string") if top else F.pmod(s[h], F.lit(256)).cast("string") for h in "lr" for top in (True, False)]))

    def date(self, token: Column, layout: str) -> Column:
        day = F.datediff(_day(token, layout), F.lit(DAY_0).cast("date"))
        at = self.feistel(F.floor(day / DAYS[1]), F.pmod(day, F.lit(DAYS[1])), _long(DAYS[0]), _long(DAYS[1]), "date")
        return _using(at, lambda s: F.date_format(F.date_add(F.lit(DAY_0).cast("date"), (s["l"] * DAYS[1] + s["r"]).cast("int")), layout))

    def pseudonym(self, token: Column) -> Column:
        """What stands for a validated token."""
        digits = _digits(token)
        digest = lambda n: F.substring(F.sha2(F.concat(F.lit(self.key + "|"), F.lower(token)).cast("binary"), 256), F.lit(1), n)
        email = token if self.inverse else F.concat(F.lit("u"), digest(F.lit(12)), F.lit("@"), F.substring_index(token, "@", -1))
        secret = token if self.inverse else digest(F.length(token))
        n = F.length(digits)
        phone = in_format(token, F.concat(F.substring(digits, F.lit(1), n - 10), self.digits(F.substring(digits, n - 9, F.lit(10)), "phone")))
        code = F.length(F.regexp_extract(token, "^.([0-9]+)", 1))
        abroad = in_format(token, F.concat(F.substring(digits, F.lit(1), code), self.digits(F.substring(digits, code + 1, n - code), "phone")))
        out = F.when(token.contains("@"), email).when(_is(token, "secret"), secret).when(_is(token, "ip"), self.address(token))
        for kind, layout in LAYOUTS.items():
            out = out.when(_is(token, kind), self.date(token, layout))
        return out.when(_is(token, "phone"), phone).when(_is(token, "abroad"), abroad).when(_is(token, "social"), self.social(token)).otherwise(in_format(token, self.account(digits)))


def _using(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _is(token: Column, kind: str) -> Column:
    return token.rlike("^(?:" + PATTERNS[kind] + ")$")


def _digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def _octets(token: Column) -> Column:
    return F.transform(F.split(token, r"\."), lambda x: x.cast("int"))


def _day(token: Column, layout: str) -> Column:
    return F.try_to_timestamp(token, F.lit(layout)).cast("date")


def _social(token: Column) -> tuple[Column, Column, Column]:
    return tuple(F.substring(token, F.lit(at), F.lit(n)).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))


def luhn(prefix: Column) -> Column:
    """The digit that makes prefix + digit valid by the mod-10 rule."""

    def add(s: Column, i: Column) -> Column:
        d = F.substring(prefix, -i, F.lit(1)).cast("int")
        twice = F.when(d >= 5, 2 * d - 9).otherwise(2 * d)
        return s + F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(prefix)), F.lit(0), add)
    return F.pmod(10 - total % 10, F.lit(10))


def in_format(token: Column, digits: Column) -> Column:
    """The digits put back at the places of the token's digits."""
    rest = F.regexp_replace(token, "[0-9]", "#")

    def put(s: Column, i: Column) -> Column:
        c = F.substring(rest, i, F.lit(1))
        hit = c == "#"
        return F.struct(F.concat(s["o"], F.when(hit, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("o"), (s["k"] + hit.cast("int")).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.length(token)), F.struct(F.lit("").alias("o"), F.lit(1).alias("k")), put, lambda s: s["o"])


def valid(token: Column) -> Column:
    """Whether what a pattern found passes its kind's validation."""
    area, group, serial = _social(token)
    out = F.when(token.contains("@") | _is(token, "secret"), True).when(_is(token, "ip"), F.array_max(_octets(token)) <= 255)
    for kind, layout in LAYOUTS.items():
        out = out.when(_is(token, kind), _day(token, layout).isNotNull())
    out = out.when(_is(token, "phone") | _is(token, "abroad"), True).when(_is(token, "social"), (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0))
    return out.otherwise(_using(_digits(token), lambda d: luhn(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, -1, 1).cast("int")))


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many _ behind it as it takes to be no other column's."""
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


def replaced(documents: DataFrame, inverse: bool = False, key: str = KEY, found: str = "n_found") -> DataFrame:
    """The rows with pseudonyms in `text` and the number of validated findings in the column `found` (long; an own column of that name is
    replaced: give another name to keep it)."""
    cipher, names = Cipher(key, inverse), [c for c in documents.columns if c != found]
    tokens = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    new = F.concat(F.transform(tokens, lambda t: F.when(valid(t), cipher.pseudonym(t)).otherwise(t)), F.array(F.lit("")))
    text = F.array_join(F.zip_with(F.split("text", ANY, -1), new, lambda g, r: F.concat(g, r)), "")
    likely = F.coalesce(F.col("text").rlike(LIKELY), F.lit(False))
    plain = documents.where(~likely).select(*names, F.lit(0).cast("long").alias(found))
    # Other texts never meet the patterns, those without a finding never the permutations.
    rich = documents.where(likely).select(*names, F.size(F.filter(tokens, valid)).cast("long").alias(found))
    return plain.unionByName(rich.withColumn("text", F.when(F.col(found) > 0, text).otherwise(F.col("text"))))


def restore(documents: DataFrame, key: str = KEY) -> DataFrame:
    """Numbers, addresses and dates as they were before `replaced` under the same key."""
    return replaced(documents, inverse=True, key=key)


def key_of(spark: SparkSession) -> str:
    """The session's key; where it is unset the one in the source, with a warning: pseudonyms under it can be undone by anyone."""
    key = spark.conf.get(KEY_SETTING, None)
    if key is None:
        warnings.warn(f"{KEY_SETTING} is unset: the key for tests is used, which keeps nothing secret", stacklevel=2)
    return key or KEY


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms: doc_id, text, n_found."""
    return replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), key=key_of(spark)).select("doc_id", "text", "n_found")


def without_pii(documents: DataFrame) -> DataFrame:
    """The rows in their own columns (whatever their names), texts with pseudonyms under the session's key, n_chars following."""
    rows = replaced(documents, key=key_of(documents.sparkSession), found=free_name("_found", documents.columns))
    if "n_chars" in documents.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return rows.select(*documents.columns)
