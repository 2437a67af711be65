"""Private data replaced by format-preserving pseudonyms, in DataFrame functions only.

One pattern finds candidates; each is validated (Luhn check of card numbers,
real calendar dates, octet ranges, number plans) and then permuted by a keyed
Feistel network over its own set of values: cards keep their first digit,
length, spacing and a right check digit; phone numbers stay in the numbering
plan; addresses stay addresses; account numbers keep their country and get
right check digits; dates stay dates of the same 400 years, under one
permutation for all ways to write them. Equal values get equal pseudonyms in
every document, and unequal values of a kind get unequal ones. E-mail names and secrets, which
have no such set, become keyed digests in their own shape; a secret is taken to the
end of its run, whatever its length.

Defined results: a null text stays null with 0 values; candidates that fail
validation stay as they are; where two kinds could begin at one place the first
in the order below is taken; repeated rows are treated alike; a very long text
takes time and memory in proportion to its length; an empty table stays empty;
other columns are kept by ``pseudonymize`` and never read, but one that has the
name of the wanted count is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only for tests and the fixed queries; real runs pass their own key.
DEFAULT_KEY = "daftar-public-test-key"
ROUNDS = 8
#: The candidate kinds, in order of precedence, as Java patterns.
#: A secret value is a whole run of eight characters or more, of any length; a full stop or mark after it is not part of it.
VALUE = r"[A-Za-z0-9+/_\-.~%@$!#][A-Za-z0-9+/_\-.~%@$!#=:]{6,}[A-Za-z0-9+/_\-~%@$#=]"
SECRET = rf"""\b(?i:password|passwd|pwd|token|secret|api_?key|access_?key)\s{{0,3}}[=:]\s{{0,3}}["']?{VALUE}["']?"""
EMAIL = r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}"
PHONE = r"(?<![\w.])(?:\+1[ .\-]?)?\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}(?![\w])"
#: Other countries' numbers with + and code, and the national forms of fr, de and es.
ABROAD = (
    r"(?<![\w.+])(?:\+(?=(?:[ .\-/()]{0,3}\d){8,15}(?![ .\-/]?\d))[2-9]\d{0,2}(?:[ .\-/]?(?:\(0?\d{0,4}\)[ .\-/]?)?\d{1,12}){1,7}"
    r"|0[1-9](?:\d{8}|(?: \d{2}){4}|(?:\.\d{2}){4}|(?:-\d{2}){4})|0[1-9]\d{1,4}[ /]\d{5,8}|[67]\d{2}(?:[ \-]\d{3}[ \-]\d{3}|(?:[ \-]\d{2}){3}))(?!\w|[.\-]\d)"
)
IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
SSN = r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
DATE = r"(?<![\w/\-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/\-])"
CARD = r"(?<![\w.])\d(?:[ \-]?\d){12,18}(?!\w|\.\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_GROUPS = "[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}"
IP6 = rf"(?<![\w:.])(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|{_GROUPS}::(?:{_GROUPS})?)(?![\w:.])"
# --- fixed values: month names ---
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}
_NAMES = "|".join(dict.fromkeys(" ".join(MONTHS.values()).split()))
NAMED = rf"(?<![\w.])\d{{1,2}}(?:\.|er|º)? (?:de )?(?i:{_NAMES})(?: de)? \d{{4}}(?!\w)"
ANY = "|".join((SECRET, EMAIL, IBAN, IP6, NAMED, DATE, SSN, PHONE, ABROAD, IP, CARD))
#: Dates of 400 years from this day on are permuted: those up to the twelfth of a month, whose day can be read as a month, among
#: themselves, and so the rest. Each part's size is a product of two factors.
FIRST_DAY, EARLY, LATE = "1800-01-01", (240, 240), (9, 9833)
#: A character that separates matches while a text is cut.
MARK = "\x01"


def _round(key: Column, tweak: Column, i: Column, value: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", key, tweak, i.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")


def feistel(key: Column, tweak: Column, x: Column, y: Column, a: Column, b: Column) -> Column:
    """A keyed permutation of pairs (x, y), 0 <= x < a and 0 <= y < b, as struct<x, y>."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))

    def step(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        new_x = F.when(even, F.pmod(s["x"] + _round(key, tweak, i, s["y"]), a.cast("long"))).otherwise(s["x"])
        new_y = F.when(even, s["y"]).otherwise(F.pmod(s["y"] + _round(key, tweak, i, s["x"]), b.cast("long")))
        return F.struct(new_x.alias("x"), new_y.alias("y"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _padded(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def feistel_digits(key: Column, tweak: Column, digits: Column) -> Column:
    """A digit string permuted among those of its length (2 to 36 digits)."""
    n = F.length(digits)
    u = (n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    left, right = F.substring(digits, F.lit(1), u).cast("long"), F.substring(digits, u + 1, n).cast("long")
    out = feistel(key, F.concat(tweak, n.cast("string")), left, right, power(u), power(n - u))
    return F.concat(_padded(out["x"], u), _padded(out["y"], n - u))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string whose last digit counts once."""
    chars = F.split(F.reverse(digits), "")

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        return F.when(F.pmod(i, F.lit(2)) == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.transform(chars, worth), F.lit(0), lambda s, v: s + v)


def fill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by those of ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(digits, s["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["k"] + F.when(digit, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.split(shape, ""), start, step)["out"]


def respaced(shape: Column, chars: Column, gap: str = " ") -> Column:
    """``shape`` with all but its gaps replaced, in order, by ``chars``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(s: Column, c: Column) -> Column:
        stays = c == gap
        return F.struct(F.concat(s["out"], F.when(stays, c).otherwise(F.substring(chars, s["k"] + 1, F.lit(1)))).alias("out"), (s["k"] + F.when(stays, 0).otherwise(1)).alias("k"))

    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), start, step)["out"]


def _card(key: Column, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    body = F.concat(F.substring(digits, 1, 1), feistel_digits(key, F.lit("card"), F.substring(digits, F.lit(2), n - 2)))
    check = F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    return F.when(F.pmod(luhn_sum(digits), F.lit(10)) == 0, fill(m, F.concat(body, check.cast("string"))))


def _phone(key: Column, m: Column) -> Column:
    """Ten digits: those of the numbering plan (area and exchange from 200 to 999) among themselves, others by class of leading digits."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    ten = F.right(digits, F.lit(10))
    area, exchange, line = F.substring(ten, 1, 3).cast("long"), F.substring(ten, 4, 3).cast("long"), F.substring(ten, 7, 4).cast("long")
    out = feistel(key, F.lit("phone"), area - 200, (exchange - 200) * 10000 + line, F.lit(800), F.lit(8_000_000))
    inside = F.concat((out["x"] + 200).cast("string"), _padded(out["y"] + 2_000_000, 7))
    low = F.concat(F.substring(ten, 1, 3), F.substring(ten, 4, 1), feistel_digits(key, F.lit("phone"), F.substring(ten, 5, 6)))
    other = F.concat(F.substring(ten, 1, 1), feistel_digits(key, F.lit("phone"), F.substring(ten, 2, 9)))
    new = F.when(area < 200, other).when(exchange >= 200, inside).otherwise(low)
    return fill(m, F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), new))


def _ip(key: Column, m: Column) -> Column:
    part = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    out = feistel(key, F.lit("ip"), part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536))
    half = lambda v: F.concat(F.floor(v / 256).cast("string"), F.lit("."), F.pmod(v, F.lit(256)).cast("string"))
    return F.when(F.forall(part, lambda x: x <= 255), F.concat(half(out["x"]), F.lit("."), half(out["y"])))


def _late_before(month: Column) -> Column:
    """Days after the twelfth in the months before ``month``, counted from FIRST_DAY."""
    first = F.lit(FIRST_DAY).cast("date")
    return F.datediff(F.add_months(first, month.cast("int")), first) - 12 * month


def permuted_day(key: Column, day: Column) -> Column:
    """The date that stands for ``day``; null outside the 400 years."""
    first = F.lit(FIRST_DAY).cast("date")
    month, of_month = (F.year(day) - 1800) * 12 + F.month(day) - 1, F.dayofmonth(day)
    late = of_month > 12
    rank = F.when(late, _late_before(month) + of_month - 13).otherwise(month * 12 + of_month - 1)
    a, b = (F.when(late, F.lit(LATE[k])).otherwise(F.lit(EARLY[k])) for k in (0, 1))
    out = feistel(key, F.when(late, "date+").otherwise("date-"), F.pmod(rank, a), F.floor(rank / a), a, b)

    def back(s: Column) -> Column:
        r, a = s["r"], F.floor(s["r"] / (LATE[0] * LATE[1] / 4800)).cast("int")
        new = F.element_at(F.filter(F.sequence(a - 2, a + 2), lambda m: (_late_before(m) <= r) & (r < _late_before(m + 1))), 1)
        of_late = F.date_add(F.add_months(first, new), (r - _late_before(new) + 12).cast("int"))
        return F.when(s["late"], of_late).otherwise(F.date_add(F.add_months(first, F.floor(r / 12).cast("int")), F.pmod(r, F.lit(12)).cast("int")))

    # one element, so that the network is computed once
    one = F.array(F.struct((out["y"] * a + out["x"]).alias("r"), late.alias("late")))
    return F.when(F.year(day).between(1800, 2199), F.transform(one, back)[0])


def _day(y: Column, m: Column, d: Column) -> Column:
    """A real date or null."""
    return F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("yyyy-MM-dd")).cast("date")


def _date(key: Column, m: Column) -> Column:
    """A real date in figures, written in its own form; between slashes day first if that is a date, else month first."""
    part = lambda a, n: F.substring(m, a, n)
    ymd, slash = m.rlike(r"^\d{4}"), m.contains("/")
    day_first = _day(part(7, 4), part(4, 2), part(1, 2))
    day = F.when(ymd, _day(part(1, 4), part(6, 2), part(9, 2))).otherwise(F.coalesce(day_first, F.when(slash, _day(part(7, 4), part(1, 2), part(4, 2)))))
    form = F.when(ymd, F.when(slash, "y/").otherwise("y-")).when(~slash, "d.").when(day_first.isNotNull(), "d/").otherwise("m/")

    def written(s: Column) -> Column:
        new = lambda f: F.date_format(s["day"], f)
        return F.when(s["form"] == "y/", new("yyyy/MM/dd")).when(s["form"] == "y-", new("yyyy-MM-dd")).when(s["form"] == "d.", new("dd.MM.yyyy")).when(s["form"] == "d/", new("dd/MM/yyyy")).otherwise(new("MM/dd/yyyy"))

    return F.transform(F.array(F.struct(permuted_day(key, day).alias("day"), form.alias("form"))), written)[0]


def _named_date(key: Column, m: Column) -> Column:
    """A date with the name of its month, in its own language and letter case."""
    form = rf"^(\d{{1,2}})((?:\.|er|º)? (?:de )?)({_NAMES})((?: de)? )(\d{{4}})$"
    got = lambda k: F.regexp_extract(m, "(?i)" + form, k)
    name = F.lower(got(3))
    lists = [F.array(*map(F.lit, x.split())) for x in MONTHS.values()]
    names = F.coalesce(*(F.when(F.array_contains(x, name), x) for x in lists))
    day = _day(got(5), F.lpad(F.array_position(names, name).cast("string"), 2, "0"), F.lpad(got(1), 2, "0"))

    def written(s: Column) -> Column:
        new = F.element_at(s["names"], F.month(s["day"]))
        capital = F.initcap(new)
        shown = F.when(s["name"] == F.lower(s["name"]), new).when(s["name"] == F.upper(s["name"]), F.upper(new)).otherwise(capital)
        return F.concat(F.dayofmonth(s["day"]).cast("string"), got(2), shown, got(4), F.year(s["day"]).cast("string"))

    return F.transform(F.array(F.struct(permuted_day(key, day).alias("day"), names.alias("names"), got(3).alias("name"))), written)[0]


def _mod97(text: Column) -> Column:
    """The remainder by 97 of the digits that letters and digits stand for."""
    def step(s: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        return F.pmod(F.when(letter, s * 100 + F.ascii(c) - 55).otherwise(s * 10 + F.ascii(c) - 48), F.lit(97))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _iban(key: Column, m: Column) -> Column:
    """Country, letters and spacing stay; the account's digits are permuted and the check digits made right."""
    compact = F.replace(m, F.lit(" "), F.lit(""))
    country, account = F.substring(compact, 1, 2), F.substring(compact, F.lit(5), F.length(compact))
    digits = F.regexp_replace(account, "[^0-9]", "")
    new = F.transform(F.array(fill(account, feistel_digits(key, F.concat(F.lit("iban"), country), digits))), lambda a: F.concat(country, _padded(98 - _mod97(F.concat(a, country, F.lit("00"))), 2), a))[0]
    spaced = respaced(m, new)
    return F.when((_mod97(F.concat(account, F.substring(compact, 1, 4))) == 1) & (F.length(digits) >= 2), spaced)


def _ip6(key: Column, m: Column) -> Column:
    """Hexadecimal digits permuted in place, the first two of 31 or 32 kept; addresses of one digit stay."""
    digits = F.lower(F.replace(m, F.lit(":"), F.lit("")))
    n = F.length(digits)
    head = F.when(n > 30, 2).otherwise(0)
    u = F.floor((n - head) / 2).cast("int")
    number = lambda c: F.conv(c, 16, 10).cast("long")
    power = lambda k: F.pow(F.lit(16.0), k).cast("long")
    v = n - head - u
    out = feistel(key, F.concat(F.lit("ip6"), n.cast("string")), number(F.substring(digits, head + 1, u)), number(F.substring(digits, head + u + 1, v)), power(u), power(v))
    hexed = F.transform(F.array(out), lambda p: F.concat(F.substring(digits, F.lit(1), head), F.lpad(F.lower(F.hex(p["x"])), u, "0"), F.lpad(F.lower(F.hex(p["y"])), v, "0")))[0]
    return F.when((n >= 2) & m.rlike("[0-9]"), respaced(m, hexed, ":"))


def _ssn(key: Column, m: Column) -> Column:
    """Area 001 to 899 among themselves, and 900 to 999; group 01 to 99, serial 0001 to 9999."""
    area, group, serial = F.substring(m, 1, 3).cast("long"), F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    high = area >= 900
    low = F.when(high, F.lit(900)).otherwise(F.lit(1))
    out = feistel(key, F.when(high, "itin").otherwise("ssn"), area - low, (group - 1) * 9999 + serial - 1, F.when(high, F.lit(100)).otherwise(F.lit(899)), F.lit(99 * 9999))
    new = F.transform(F.array(out), lambda p: F.concat_ws("-", _padded(p["x"] + low, 3), _padded(F.floor(p["y"] / 9999) + 1, 2), _padded(F.pmod(p["y"], F.lit(9999)) + 1, 4)))[0]
    return F.when((area >= 1) & (group >= 1) & (serial >= 1), new)


def _email(key: Column, m: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", key, F.lit("mail"), F.lower(m)), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 15), F.lit("@"), F.substring(digest, 20, 8), F.lit(".example"))


def _secret(key: Column, m: Column) -> Column:
    """The digest of the whole value, as many characters of it as the value has; beyond 128 further blocks are counted."""
    form = r"""^(\w+\s{0,3}[=:]\s{0,3}["']?)(.*?)(["']?)$"""
    value = F.regexp_extract(m, form, 2)
    n = F.length(value)
    block = lambda i: F.sha2(F.concat_ws("|", key, F.when(i == 0, "secret").otherwise(F.concat(F.lit("secret#"), i.cast("string"))), value), 512)
    digest = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 128).cast("int")), block), "")
    return F.concat(F.regexp_extract(m, form, 1), F.substring(digest, F.lit(1), n), F.regexp_extract(m, form, 3))


def _abroad(key: Column, m: Column) -> Column:
    """The digits after a country code (three digits after +) or a national prefix (two), permuted; the form stays."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    lead = F.when(m.startswith("+"), 3).otherwise(2)
    head = F.substring(digits, F.lit(1), lead)
    return fill(m, F.concat(head, feistel_digits(key, F.concat(F.lit("abroad"), head, F.lit("|")), F.substring(digits, lead + 1, F.length(digits)))))


def pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of one candidate, or the candidate itself if it is no valid value."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    new = (
        F.when(whole(SECRET), _secret(key, m)).when(m.contains("@"), _email(key, m)).when(whole(IBAN), _iban(key, m)).when(whole(IP6), _ip6(key, m)).when(whole(NAMED), _named_date(key, m)).when(whole(DATE), _date(key, m)).when(whole(SSN), _ssn(key, m))
        .when(whole(PHONE), _phone(key, m)).when(whole(ABROAD), _abroad(key, m)).when(whole(IP), _ip(key, m)).otherwise(_card(key, m))
    )
    return F.coalesce(new, m)


def pseudonymize(docs: DataFrame, key: str = DEFAULT_KEY, column: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with the private values of ``column`` replaced; ``count`` names a column for their number.

    A map over rows without a shuffle. Texts without a digit, @ or secret word
    skip the pattern.
    """
    text = F.col(column)
    k = F.lit(key)
    # gaps and candidates in turn, from one pass of the pattern; a text that holds the mark itself takes two
    once = F.split(F.regexp_replace(text, f"({ANY})", f"{MARK}$1{MARK}"), MARK, -1)
    gaps, found = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), 0)
    twice = F.flatten(F.zip_with(gaps, found, lambda g, m: F.when(m.isNull(), F.array(g)).otherwise(F.array(g, m))))
    likely = text.rlike(r"[0-9@]|[=:]")
    parts = F.when(likely, F.when(text.contains(MARK), twice).otherwise(once)).otherwise(F.array(text))
    changed = F.transform(F.col("_parts"), lambda p, i: F.when(F.pmod(i, F.lit(2)) == 1, pseudonym(p, k)).otherwise(p))
    n = F.aggregate(F.zip_with("_parts", "_changed", lambda a, b: F.when(a != b, 1).otherwise(0)), F.lit(0), lambda s, v: s + v).cast("long")
    # each step is a projection of its own, so that candidates are found and permuted once
    out = docs.withColumn("_parts", parts).withColumn("_changed", changed)
    if count:
        out = out.withColumn(count, F.coalesce(n, F.lit(0).cast("long")))
    return out.withColumn(column, F.when(text.isNotNull(), F.array_join("_changed", ""))).drop("_parts", "_changed")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymize(docs, count="n_values").select("doc_id", "n_values", "text")
