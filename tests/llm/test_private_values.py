"""Private values that go whole, whatever their length and country."""

import bisect
import datetime
import hashlib
import random

import pytest

from daftar.llm import pii


def pseudonyms(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pii.pseudonymize(rows).orderBy("doc_id").collect()]


@pytest.mark.parametrize("n", [8, 128, 129, 200, 1000])
def test_secrets_of_any_length_go_whole(spark, n):
    value = ("aZ3-k_9Q/+" * 100)[: n - 1] + "Z"
    other = value[:-1] + "Y"
    out = pseudonyms(spark, [f'a token="{value}" b', f'a token="{other}" b', f"pwd: {value}. End"])
    got = [t[len('a token="') : -len('" b')] for t in out[:2]]
    assert all(len(g) == n and set(g) <= set("0123456789abcdef") for g in got) and got[0] != got[1]
    assert out[2] == f"pwd: {got[0]}. End"
    if n >= 200:
        assert got[0][128:] != other[128:] and got[0][:72] != got[0][128:200]


def test_tokens_with_dots_and_padding_go_whole(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    values = [jwt, "c2VjcmV0IHZhbHVlIQ==", "john.smith@site.com", "123456789:AAFx-abcdefgh"]
    for value, out in zip(values, pseudonyms(spark, [f"token={v} rest" for v in values]), strict=True):
        assert out.startswith("token=") and out.endswith(" rest") and len(out) == len(f"token={value} rest")
        assert not any(part in out for part in value.replace("=", ".").replace("@", ".").replace(":", ".").split(".") if part)


def test_numbers_of_other_countries(spark):
    values = ["+33 6 12 34 56 78", "+49 (0)30 1234567", "+34 612 345 678", "+44 20 7946 0958", "06 12 34 56 78", "01.23.45.67.89", "030 12345678", "612 345 678"]
    out = pseudonyms(spark, [f"tel {v}, ok" for v in values])
    for value, t in zip(values, out, strict=True):
        assert t != f"tel {value}, ok" and len(t) == len(f"tel {value}, ok") and t.startswith(f"tel {value[:2]}")
    same = ["1 234 567", "v1.2.3.4.5", "2023-13-45", "10 20 30"]
    assert pseudonyms(spark, same) == same


# A plain Feistel network and plain formats to compare with.
def network(tweak, x, y, a, b, key=pii.DEFAULT_KEY):
    number = lambda i, v: int(hashlib.sha256(f"{key}|{tweak}|{i}|{v}".encode()).hexdigest()[:14], 16)
    for i in range(8):
        if i % 2 == 0:
            x = (x + number(i, y)) % a
        else:
            y = (y + number(i, x)) % b
    return x, y


def digits_of(tweak, d):
    n, u = len(d), len(d) // 2
    x, y = network(f"{tweak}{n}", int(d[:u]), int(d[u:]), 10**u, 10 ** (n - u))
    return f"{x:0{u}d}{y:0{n - u}d}"


def check_digit(body):
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


DAYS = [datetime.date(1800, 1, 1) + datetime.timedelta(k) for k in range(146_097)]
PARTS = {late: [d for d in DAYS if (d.day > 12) == late] for late in (False, True)}


def other_day(day):
    part = PARTS[day.day > 12]
    a, b, tweak = (9, 9833, "date+") if day.day > 12 else (240, 240, "date-")
    r = bisect.bisect_left(part, day)
    x, y = network(tweak, r % a, r // a, a, b)
    return part[y * a + x]


FORMS = ("%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%d.%m.%Y")


def test_dates_equal_a_plain_network(spark):
    r = random.Random(1)
    days = [r.choice(DAYS) for _ in range(60)] + [datetime.date(1800, 1, 1), datetime.date(2199, 12, 31), datetime.date(2000, 2, 29), datetime.date(1900, 2, 28), datetime.date(1999, 3, 3)]
    text = [" and ".join(d.strftime(f).zfill(10) for f in FORMS) for d in days]
    assert pseudonyms(spark, text) == [" and ".join(other_day(d).strftime(f).zfill(10) for f in FORMS) for d in days]
    late = [d for d in days if d.day > 12]
    assert pseudonyms(spark, [d.strftime("on %m/%d/%Y.") for d in late]) == [other_day(d).strftime("on %m/%d/%Y.") for d in late]
    named = {"3 March 1999": "%B", "3 march 1999": "%b", "28 February 1900": "%B"}
    for value, got in zip(named, pseudonyms(spark, list(named)), strict=True):
        new = other_day(datetime.datetime.strptime(value.title(), "%d %B %Y").date())
        want = f"{new.day} {new:%B} {new.year}"
        assert got == (want if value != value.lower() else want.lower())
    assert pseudonyms(spark, ["3. März 1999"])[0].split()[0] == f"{other_day(datetime.date(1999, 3, 3)).day}."
    assert pseudonyms(spark, ["31 June 1999", "1999-02-30", "45/45/1999", "1799-12-31", "2200-01-01"]) == ["31 June 1999", "1999-02-30", "45/45/1999", "1799-12-31", "2200-01-01"]


def test_unequal_dates_stay_unequal(spark):
    values = sorted({d.strftime(f) for d in DAYS[70_000:70_800] for f in ("%d/%m/%Y", "%m/%d/%Y")})
    assert len(set(pseudonyms(spark, values))) == len(values)


def test_numbers_equal_a_plain_network(spark):
    r = random.Random(2)
    values, want = [], []
    for _ in range(20):
        body = "4" + "".join(r.choice("0123456789") for _ in range(14))
        new, value = "4" + digits_of("card", body[1:]), body + check_digit(body)
        values.append(f"card {value[:4]} {value[4:8]}-{value[8:]}"), want.append(f"card {new[:4]} {new[4:8]}-{new[8:]}{check_digit(new)}")
    assert pseudonyms(spark, values) == want
    area, group, serial = 123, 45, 6789
    x, y = network("ssn", area - 1, (group - 1) * 9999 + serial - 1, 899, 99 * 9999)
    assert pseudonyms(spark, ["ssn 123-45-6789"]) == [f"ssn {x + 1:03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"]
    x, y = network("itin", 900 - 900, (70 - 1) * 9999 + 1, 100, 99 * 9999)
    assert pseudonyms(spark, ["900-70-0002"]) == [f"{x + 900:03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"]
    x, y = network("ip", 10 * 256 + 1, 2 * 256 + 3, 65536, 65536)
    assert pseudonyms(spark, ["10.1.2.3"]) == [f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"]
    x, y = network("phone", 415 - 200, (555 - 200) * 10_000 + 2671, 800, 8_000_000)
    assert pseudonyms(spark, ["415-555-2671"]) == [f"{x + 200}-{(y + 2_000_000) // 10_000}-{y % 10_000:04d}"]


def test_account_numbers(spark):
    mod = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
    values = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "FR14 2004 1010 0505 0001 3M02 606"]
    for value, new in zip(values, pseudonyms(spark, values), strict=True):
        short, old = new.replace(" ", ""), value.replace(" ", "")
        assert new != value and mod(short) == 1 and short[:2] == old[:2] and [c.isalpha() for c in new] == [c.isalpha() for c in value] and len(new) == len(value)
        digits = "".join(c for c in old[4:] if c.isdigit())
        assert "".join(c for c in short[4:] if c.isdigit()) == digits_of(f"iban{old[:2]}", digits)
    assert pseudonyms(spark, ["DE89 3704 0044 0532 0130 01"]) == ["DE89 3704 0044 0532 0130 01"]


def test_long_addresses(spark):
    values = ["2001:0db8:85a3:0000:0000:8a2e:0370:7334", "2001:db8::1", "fe80::1ff:fe23:4567:890a", "std::vector", "::1", "12:30:45"]
    out = pseudonyms(spark, values)
    assert out[3:] == values[3:]
    for value, new in zip(values[:3], out, strict=False):
        assert new != value and [c == ":" for c in new] == [c == ":" for c in value] and all(c in "0123456789abcdef:" for c in new)
    d = values[1].replace(":", "")
    u = len(d) // 2
    x, y = network(f"ip6{len(d)}", int(d[:u], 16), int(d[u:], 16), 16**u, 16 ** (len(d) - u))
    assert out[1].replace(":", "") == f"{x:0{u}x}{y:0{len(d) - u}x}"


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, "a\x01b 10.1.2.3 \x01", 7, 5), (1, "a\x01b 10.1.2.3 \x01", 7, 5), (None, None, None, None), (2, "", 1, 1), (3, "x 10.1.2.3 " * 20_000, 2, 2)], "doc_id long, text string, n_values int, `a b.c` int")
    got = pii.pseudonymize(rows, count="n_values").collect()
    assert [(r["doc_id"], r["n_values"], r["a b.c"]) for r in got] == [(1, 1, 5), (1, 1, 5), (None, 0, None), (2, 0, 1), (3, 20_000, 2)]
    assert got[0]["text"] == got[1]["text"] and got[0]["text"].startswith("a\x01b ") and got[0]["text"].endswith(" \x01") and got[2]["text"] is None and got[3]["text"] == ""
    assert set(got[4]["text"].split()) == {"x", got[0]["text"].split()[1]}
    assert pii.pseudonymize(rows.limit(0)).count() == 0
