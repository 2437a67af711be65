"""One row of each group stays, whatever ids repeat or are null: against brute force, and through the pipeline's stages."""

import random
from collections import defaultdict

import pytest

from daftar.llm import ngram_join
from tests.llm.test_operators import links

r = random.Random(21)
WORDS = [f"w{k}" for k in range(300)]


def text(n=30):
    return " ".join(r.choice(WORDS) for _ in range(n))


def shingles(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def allowed(rows, kept):
    """Whether ``kept`` has one row of each group, of its least id, and all rows without words."""
    root = links([t or "" for _, t in rows])
    groups = defaultdict(list)
    for k, (d, t) in enumerate(rows):
        groups[root[k] if shingles(t) else f"free {k}"].append((d, t))
    left = list(kept)
    for members in groups.values():
        least = min(((d is None, d or 0) for d, _ in members))
        fit = [m for m in members if (m[0] is None, m[0] or 0) == least]
        some = next((m for m in fit if m in left), None)
        if some is None:
            return False
        left.remove(some)
    return not left


def kept(spark, rows):
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, class_0 int, g_id int, t_id int").repartition(3)
    out = ngram_join.keep_one(docs)
    assert out.columns == docs.columns
    return [(x["doc_id"], x["text"]) for x in out.collect()]


A, B, C = text(), text(), text()


@pytest.mark.parametrize(
    ("rows", "n"),
    [
        ([(0, B), (1, A), (1, B)], 2),  # text A is linked with nothing
        ([(None, A), (None, A), (1, B)], 2),
        ([(None, A), (None, A), (1, B), (1, C)], 3),
        ([(None, A), (5, A), (5, A.upper())], 1),
        ([(1, A), (1, A), (2, A + " end"), (2, C)], 2),
        ([(1, None), (1, None), (1, ""), (None, " ")], 4),
        ([(3, A), (4, A), (4, B), (3, B)], 2),
        ([(1, A)], 1),
    ],
)
def test_small_tables(spark, rows, n):
    got = kept(spark, rows)
    assert len(got) == n and allowed(rows, got)


@pytest.mark.parametrize("seed", [1])
def test_many_rows_with_repeated_and_null_ids(spark, seed):
    r.seed(seed)
    base = [text() for _ in range(25)]
    rows = []
    for _ in range(160):
        t = r.choice(base)
        if r.random() < 0.4:
            w = t.split()
            w[r.randrange(len(w))] = r.choice(WORDS)
            t = " ".join(w)
        rows.append((r.choice([None, *range(40)]), r.choice([t, t, t, t.upper(), "  " + t, "", None])))
    assert allowed(rows, kept(spark, rows))
