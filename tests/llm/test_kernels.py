"""Kernels without Spark: tokenizer, FM-index, counts, hashes, HTML, WARC chains, calibration."""

import random

import numpy as np
import pyarrow as pa
import pytest

from daftar.llm import decontaminate as D
from daftar.llm import html_text, ngram_join, quality_classifier, quality_rules, substring_dedup, toxicity, warc

sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")


def test_sentencepiece_equals_the_library():
    from daftar.llm.sentencepiece_bpe import Codec, Model

    path = public.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(5)
    alphabet = "aaab ei nt hers\n\n  ▁é𝄞\x00\t,.-"
    texts = ["", "  ", "a  b ", " \n x", "▁a▁▁b", "\n", "a" * 2000, "ab" * 900, "é" * 50, "ﬁ x", "<s> </s> <0x0A>"]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(800)] + ["".join(r.choice("abababten ") for _ in range(r.randint(0, 40))) for _ in range(800)]
    for most in (10_000, 50):  # the second cache is cleared all the time
        c = Codec(Model(path), most)
        for k in range(0, len(texts), 200):
            part = texts[k : k + 200]
            ids, edges = c.encode(pa.array([*part, None]))
            got = list(zip(c.listed(ids, edges), c.decode(ids, edges), strict=True))
            want = [sp.encode(t) for t in [*part, ""]]
            assert got == [(",".join(map(str, w)).encode(), sp.decode(w).encode()) for w in want]


class Value:
    def __init__(self, value):
        self.value = value


def brute_hits(docs, items):
    import re

    rx = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: rx.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if some := windows.get(tuple(w[j : j + n])):
                    found |= some
                    hit[j : j + n] = [1] * n
        out.append((d, len(w), sum(hit), sorted(found)))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_fm_index_finds_every_occurrence(seed):
    r = random.Random(seed)
    vocabulary = ["a", "b", "Cé", "d1", "e"]
    items = [(str(i), " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 13, 14, 20])))) for i in range(r.randint(0, 6))]
    docs = [(i, r.choice(["", "x, "]) + " ".join(r.choice([*vocabulary, "zz"]) for _ in range(r.randint(0, 60))) + (" " + r.choice(items)[1] if items else "")) for i in range(20)] + [(99, None)]
    blocks = [Value(D.Phrases([(i, t.encode())])) for i, t in items]  # one block per item: blocks merge
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())], names=["doc_id", "text"])
    got = [(x["doc_id"], x["n_words"], x["n_hit"], x["items"]) for o in D._scan(blocks, False)(iter([batch])) for x in o.to_pylist()]
    assert got == brute_hits(docs, items)


def test_base_counts():
    import re

    def brute(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        at = {}
        for i in range(len(w) - 7):
            at.setdefault(tuple(w[i : i + 8]), []).append(i)
        flags = [0] * len(w)
        for v in at.values():
            for i in v if len(v) > 1 else ():
                flags[i : i + 8] = [1] * 8
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, sum(flags)

    r = random.Random(1)
    texts = [None, "", " ", "\n\n", "a\n\na\n a\na\n", "x " * 30, "é#\né#"] + ["".join(r.choice("ab #\n\té") for _ in range(r.randint(0, 200))) for _ in range(150)]
    c = quality_rules.text_counts(pa.array(texts))
    got = list(zip(*(c[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
    assert got == [brute(t) for t in texts]


def test_parity_never_exceeds_the_difference():
    r = np.random.default_rng(0)
    for n in (5, 60, 300, 1000):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], r.integers(0, 2**63, n // 3).astype(np.uint64))))
        assert ngram_join.differing(ngram_join.parity(a), ngram_join.parity(b)) <= len(np.setxor1d(a, b))
        assert ngram_join.differing(ngram_join.parity(a), ngram_join.parity(a)) == 0


def test_similar_sets_share_a_key():
    """Whatever the classes of shingles, two sets of similarity 0.8 meet at a key."""
    r = np.random.default_rng(3)
    frequent = r.random(1 << ngram_join.BITS) < 0.7
    for n in [*range(1, 40), 80, 150, 400]:
        for _ in range(6):
            base = np.unique(r.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + r.integers(0, 2, n).astype(np.uint64))
            gone = int(0.2 * len(base))
            other = np.sort(base[r.permutation(len(base))[gone:]])
            if 5 * len(np.intersect1d(base, other)) < 4 * len(np.union1d(base, other)):
                continue
            assert len(np.intersect1d(ngram_join.prefix_keys(base, frequent)[0], ngram_join.prefix_keys(other, frequent)[0]))


def test_automaton_knows_the_least_document():
    r = random.Random(2)
    texts = [(r.randint(0, 50), [r.choice("abc") for _ in range(r.randint(3, 30))]) for _ in range(40)]
    a = substring_dedup.Automaton()
    for d, w in texts:
        a.add(w, d)
    a.finish()
    least = {}
    for d, w in texts:
        for i in range(len(w) - 3):
            least[tuple(w[i : i + 4])] = min(d, least.get(tuple(w[i : i + 4]), 99))
    for _, w in texts:
        assert a.least_documents(w, 4) == [least[tuple(w[i : i + 4])] for i in range(len(w) - 3)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="ad">Buy now</div><article><h1>Title &amp; more</h1><p>First <b>long paragraph of the article that carries much text<br>and a line break.<p>Second&nbsp;paragraph,
with  white space.</p><aside>See also</aside><form><p>Your mail</p></form><p>End.</p></article><div class="comments"><p>Great article, thanks a lot for writing it, it was a pleasure to read it</p></div><footer>&copy; Site</footer></body></html>"""


def test_html_article():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst long paragraph of the article that carries much text and a line break.\n\nSecond paragraph, with white space.\n\nEnd."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("plain  text") == "plain text"
    body = "".join(f"<p>Paragraph {k} with enough words to be content of the page.</p>" for k in range(5))
    assert html_text.main_text(f"<body><nav>n</nav><div>{body}</div><footer>f</footer>").count("Paragraph") == 5


def test_chain_rejects_magic_in_payloads():
    inner = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    one = lambda body: b"WARC/1.0\r\nX: y\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    data = one(b"x") + one(inner) + one(b"") + one(b"WARC/1.0\r\n")
    found = warc.candidates(data, 0, len(data), len(data))
    o, s = np.array([f[0] for f in found]), np.array([f[1] for f in found])
    keep = warc.reachable(o, s)
    assert len(found) > 4 and keep.sum() == 4 and s[keep].max() == len(data)


def test_isotonic_is_monotone():
    x, y = quality_classifier.isotonic(np.array([5.0, 0, 5, 5]), np.array([1.0, 0, 0, 5]))
    assert (np.diff(y) >= 0).all() and len(x) == 2


def test_ordinal_orders_grades():
    r = np.random.default_rng(0)
    x = r.random((600, 2))
    y = np.digitize(x[:, 0] + 0.1 * r.standard_normal(600), [0.4, 0.6, 0.8])
    m = toxicity.Ordinal.fit(x, y, np.ones(600))
    p = m.probabilities(x)
    assert (np.diff(m.theta) > 0).all() and np.allclose(p.sum(1), 1) and np.corrcoef(p @ np.arange(4), y)[0, 1] > 0.85
