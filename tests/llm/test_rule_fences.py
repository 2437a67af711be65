"""Fences of the quality rules in sources with much junk and in sources of unlike texts."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from daftar.llm import quality_rules

DOC = "doc_id long, lang string, source string, text string"


def rules_table(spark, share):
    """100 sources of clean prose, one in which ``share`` of the rows is symbol junk."""
    clean = lambda k: "\n".join(" ".join(f"word{(k * 7 + i * j) % 997}" for i in range(1, 9)) for j in range(1, 8 + k % 40))
    junk = lambda k: " ".join(f"#$%{i * k % 89}xy" for i in range(1, 60 + k % 50))
    rows = [(k, "en", f"s{k % 4}", clean(k)) for k in range(600)]
    bad = int(200 * share)
    return spark.createDataFrame(rows + [(1000 + k, "en", "hot", junk(k) if k < bad else clean(k)) for k in range(200)], DOC), bad


@pytest.mark.parametrize("share", [0.3, 0.4, 0.5])
def test_a_source_with_much_junk_loses_it(spark, share):
    docs, bad = rules_table(spark, share)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs).filter("not base_failed").collect()}
    assert len(got) > 700 and not any(got.get(1000 + k) for k in range(bad))
    clean = [v for k, v in got.items() if k < 1000 or k >= 1000 + bad]
    assert sum(clean) / len(clean) > 0.98


def test_fences_follow_their_group(spark):
    """Long texts and short ones have other fences, and a repeat ratio below the base rule's can be rejected."""
    text = lambda k, n: "\n".join(" ".join(f"w{(k * 31 + i + 8 * j) % 99991}" for i in range(8)) for j in range(n))
    rows = [(k, "en", ("short", "long")[k % 2], text(k, (4, 200)[k % 2] + k % 7)) for k in range(400)]
    block = " ".join(f"r{i}" for i in range(100))
    rows.append((999, "en", "long", text(5, 160) + "\n" + block + "\n" + block))
    out = quality_rules.quality_rules(spark.createDataFrame(rows, DOC))
    fence = {r["source"]: r for r in out.groupBy("source").agg(*(F.first(f"max_{r}").alias(r) for r in quality_rules.RATIOS)).collect()}
    assert all(fence["short"][r] > fence["long"][r] + 1 for r in quality_rules.RATIOS)
    repeats = out.filter("doc_id = 999").first()
    assert not repeats["base_failed"] and not repeats["kept"]
    assert out.filter("doc_id < 999 and not kept").count() == 0


def plain_counts(text):
    """(words, word characters, symbols, lines, repeated lines, words in repeated windows)."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(again)


def plain_fences(rows):
    """rows: (lang, source, counts); the fence of each group and ratio."""
    parts = ((2, 1), (4, 3), (5, 0))
    step = math.log(1.04)
    odds = lambda c, a, b: math.log((c[a] + 0.5) / (max(max(c[b], 0) - c[a], 0) + 0.5))

    def quartiles(some, k):
        b = sorted(math.ceil(odds(c, *parts[k]) / step) for c in some)
        return tuple(b[math.ceil(q * len(b)) - 1] * step for q in (0.25, 0.75))

    groups, langs = {}, {}
    for lang, source, c in rows:
        groups.setdefault((lang, source), []).append(c), langs.setdefault(lang, []).append(c)
    out = {}
    for (lang, source), some in groups.items():
        for k in range(3):
            a1, a3 = quartiles([c for _, _, c in rows], k)
            l1, l3 = quartiles(langs[lang], k)
            q1, q3 = quartiles(some, k)
            mix = lambda n, x, p: (n * x + 100 * p) / (n + 100)
            lq, lr = mix(len(langs[lang]), l1, a1), mix(len(langs[lang]), min(l3 - l1, a3 - a1), a3 - a1)
            spread = max(mix(len(some), min(q3 - q1, lr), lr), 0.5)
            out[lang, source, k] = mix(len(some), q1, lq) + 4 * spread
    return out, lambda c, k: odds(c, *parts[k])


def test_verdicts_equal_brute_force(spark):
    r = random.Random(8)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, r.choice(["en", "de", None]), r.choice(["a", "b", "c", None]), "\n".join(" ".join(r.choice(words) for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 25)))) for i in range(300)]
    rows += [(1000 + i, "en", "a", " ".join(r.choice(["#$%", "a|b", "x"]) for _ in range(60))) for i in range(20)] + [(2000, "de", "b", None), (None, "de", "b", ""), (2001, "fr", "z", "one " * 30), (3, *rows[3][1:])]
    counts = {i: plain_counts(x[3]) for i, x in enumerate(rows)}
    fences, odds = plain_fences([(x[1], x[2], counts[i]) for i, x in enumerate(rows)])
    want = []
    for i, (doc, lang, source, _) in enumerate(rows):
        c = counts[i]
        failed = c[0] < 20 or 100 * c[5] > 30 * c[0]
        want.append((doc, *c[:3], *c[4:], failed, not failed and all(odds(c, k) <= fences[lang, source, k] for k in range(3))))
    docs = spark.createDataFrame([(*x, 1, "f", 2.0) for x in rows], "doc_id long, lang string, source string, text string, n_words int, f_lang string, max_symbol_ratio double")
    got = [(x["doc_id"], x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"], x["kept"]) for x in quality_rules.quality_rules(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and 20 < sum(x[-1] for x in want) < len(want) - 20
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0
