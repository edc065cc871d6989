import html
import math
import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.llm import words as words_module
from ridgeline.llm.leakage import EDIT, MOST_EDITS, WINDOW, _match, _until, excerpts, leaks
from ridgeline.llm.words import LOOK_ALIKES, split_words, word_shares, words

LEAST = WINDOW - WINDOW // EDIT
VOCABULARY = [f"{a}{b}{c}" for a in ("kor", "mel", "tus", "vin", "dra") for b in ("a", "o", "e") for c in ("bex", "lun", "rit", "sog", "pim", "dax")]


def passage(r, n=40):
    return [r.choice(VOCABULARY) for _ in range(n)]


def plain_words(text):
    """One text by itself, character by character."""
    text = html.unescape(re.sub(r"</?[a-zA-Z][^<>]{0,200}>|<!--.{0,2000}?-->", " ", text, flags=re.S))
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in ("Mn", "Cf", "Me"))
    text = re.sub(r"(?<=\w)['’ʼ`](?=\w)", "", text.translate(str.maketrans(LOOK_ALIKES)).lower())
    found, shares = re.findall(r"[^\W_]+(?:[-‐‑][^\W_]+)*", text), []
    for w in found:
        n = len(re.findall(r"[^\W_]+", w))
        shares += [1 / n] * n
    return re.findall(r"[^\W_]+", text), shares


def longest_excerpt(doc, item, shares=None, edits=MOST_EDITS):
    """Brute force: for every equal pair of words and number of edits the best chain, over all pairs before it."""
    at = _until(np.ones(len(item)) if shares is None else shares)
    pairs = [(i, j) for i in range(len(item)) for j in range(len(doc)) if item[i] == doc[j]]
    best, most = {}, 0.0
    for i, j in pairs:
        for e in range(edits + 1):
            value = at[i + 1] - at[i]
            for i2, j2 in pairs:
                if i2 < i and j2 < j:
                    cost = math.ceil(max(at[i] - at[i2 + 1], j - j2 - 1) - 1e-6)
                    if cost <= e:
                        value = max(value, best[i2, j2, e - cost] + at[i + 1] - at[i])
            best[i, j, e] = value
            if e * (EDIT - 1) <= value + 1e-4:
                most = max(most, value)
    return most


def excerpt_words(doc, item, shares=None, edits=MOST_EDITS):
    code = {w: k for k, w in enumerate([*item, *doc])}
    a, b = (np.array([code[w] for w in x], np.int64) for x in (item, doc))
    return float(excerpts([_match(a, _until(np.ones(len(a)) if shares is None else shares), b, _until(np.ones(len(b))), edits, 0)], edits)[0])


def test_words_compare_without_looks():
    plain = ["after", "the", "reports", "warm", "up", "dont", "cafe", "full", "no"]
    assert words("AFTER  thе <b>rероrts</b>,\n> wa\u00adrm-up don’t café ＦＵＬＬ ΝΟ") == plain
    assert words(None) == words("") == words("<br/> ... !") == []
    assert words("a < b and c > d &amp; e") == ["a", "b", "and", "c", "d", "e"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aB1é-‐'’ .,;&<>/_\n\u0301ßΝе中…\u00ad½Ⅷ"), max_size=30), st.text(max_size=20).filter(lambda t: not set("\x00\x01´ʼ") & set(t))), max_size=6))
def test_blocks_split_as_single_texts(texts):
    got, shares = [], []
    for _, w in split_words(texts):
        for lo, hi in zip([0, *w.ends[:-1]], w.ends, strict=True):
            got.append([w.terms[k] for k in w.codes[lo:hi]])
            shares.append(w.shares[lo:hi].tolist())
    assert list(zip(got, shares, strict=True)) == [tuple(plain_words(t or "")) for t in texts]


def test_long_texts_are_blocks_of_their_own(monkeypatch):
    monkeypatch.setattr(words_module, "BLOCK", 20)
    texts = ["a b", "c " * 30, None, "d", "e f \x00 g x01h"]
    blocks = list(split_words(texts))
    assert len(blocks) > 2 and [(first, [w.terms[k] for k in w.codes]) for first, w in blocks][1] == (1, ["c"] * 30)
    assert [w.terms[k] for _, w in blocks for k in w.codes] == ["a", "b", *["c"] * 30, "d", "e", "f", "g", "x01h"]
    assert list(split_words([])) == []


def test_hyphenated_words_count_once():
    text = "the cool-down no <b>pupils</b> restored-the-warm-up in Tamora’s - house"
    assert len(word_shares(text)) == len(words(text)) and round(sum(word_shares(text)), 9) == 8
    assert word_shares(None) == []
    item = list(range(12))
    assert excerpt_words(item, item) == 12 and abs(excerpt_words(item, item, [1.0] * 8 + [0.5] * 4) - 10) < 1e-3
    # a hyphenated word changed is one edit
    hyphenated = [1.0] * 6 + [0.5, 0.5] + [1.0] * 7
    changed = [f"w{k}" for k in range(15)]
    doc = changed[:6] + ["x"] + changed[8:]
    assert excerpt_words(doc, changed, hyphenated) == 13


def test_aligned_words():
    r = random.Random(1)
    item = passage(r)
    assert excerpt_words(item[10:25], item) >= 15
    changed = item[5:25]
    changed[7] = "x"
    del changed[12]
    changed.insert(3, "y")
    assert excerpt_words(["q", *changed, "q"], item) >= 17
    assert excerpt_words(["q"] * 30, item) == 0 and excerpt_words([], item) == 0
    apart = [w for x in item[:16] for w in (x, "a", "b", "c")]
    assert excerpt_words(apart, item) < 6


def test_alignment_equals_brute_force():
    r = random.Random(11)
    for n in range(60):
        few = VOCABULARY[: r.choice([3, 8, 30])]
        item = [r.choice(few) for _ in range(r.randint(1, 26))]
        doc = [w for w in item if r.random() > 0.15] if n % 2 else [r.choice(few) for _ in range(r.randint(0, 25))]
        for _ in range(r.randint(0, 4)):
            doc.insert(r.randint(0, len(doc)), r.choice([*few, "other"]))
        shares = [r.choice([1.0, 1.0, 0.5]) for _ in item]
        for edits in (2, 5):
            assert abs(excerpt_words(doc, item, shares, edits) - longest_excerpt(doc, item, shares, edits)) < 1e-3


def test_arrays_of_all_sizes_are_aligned_together():
    r = random.Random(2)
    item = passage(r, 30)
    code = {w: k for k, w in enumerate(VOCABULARY)}
    own = np.array([code[w] for w in item])
    parts = [np.array([code[w] for w in (item[:n] + passage(r, n))], np.int64) for n in range(0, 30, 3)]
    at = _until(np.ones(30))
    matches = [_match(own, at, p, _until(np.ones(len(p))), 6, 0) for p in parts]
    assert excerpts(matches, 6).tolist() == [float(excerpts([m], 6)[0]) for m in matches]


@pytest.mark.parametrize("first", [True, False])
def test_a_weak_long_chain_hides_no_excerpt(spark, first):
    item = [f"w{k}" for k in range(60)]
    exact, weak = item[44:60], [w if k % 4 else f"x{k}" for k, w in enumerate(item[:40], 1)]
    doc = exact + ["between"] * 20 + weak if first else weak + ["between"] * 20 + exact
    assert excerpt_words(doc, item) == 16
    docs = spark.createDataFrame([(1, " ".join(doc))], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, " ".join(item))], "eval_id bigint, passage string")
    assert [tuple(x) for x in leaks(docs, "doc_id", "text", items, "eval_id", ["passage"]).collect()] == [(1, 5, "passage", 16)]


def test_long_items_and_several_blocks_of_items(spark):
    r = random.Random(8)
    long = [f"l{k}" for k in range(1000)]
    items = [(1, " ".join(long)), (2, " ".join(passage(r))), (3, " ".join(long[500:530]))]
    docs = [(k, " ".join(["x"] * 9 + long[at : at + 20] + ["x"] * 9)) for k, at in enumerate(range(0, 981, 60))] + [(900, items[1][1] + " " + " ".join(long))]
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", spark.createDataFrame(items, "eval_id bigint, question string"), "eval_id", ["question"]
    one = {tuple(x) for x in leaks(*frames).collect()}
    assert {(d, e) for d, e, _, _ in one} == {(d, 1) for d, _ in docs} | {(900, 2), (900, 3)}
    assert all(n == 20 for d, e, _, n in one if d < 900)
    assert {tuple(x) for x in leaks(*frames, block_words=300).collect()} == one


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(7)
    stock = [" ".join(r.choice(["good", "bad", "parcel", "price", "colour", "seller", "week", "manual"]) for _ in range(8)) for _ in range(12)]
    items = {k: (passage(r), passage(r, 22)) for k in range(40)}
    for k in range(0, 40, 4):
        items[k] = (items[k][0][:15] + r.choice(stock).split() + items[k][0][15:], items[k][1])
    docs, truth = [], set()
    for d in range(300):
        body = [r.choice(stock) for _ in range(r.randint(2, 6))]
        kind = r.random()
        if kind < 0.5:
            k, part = r.randrange(40), r.randrange(2)
            own = items[k][part]
            size = r.randint(15, len(own)) if kind < 0.35 else r.randint(6, 10)
            at = r.randrange(len(own) - size + 1)
            cut = list(own[at : at + size])
            if kind < 0.35:
                truth.add((d, k))
                for e in range(size // EDIT):
                    j = min(len(cut) - 1, e * EDIT + r.randrange(EDIT))
                    how = r.randrange(3)
                    if how == 0:
                        cut[j] = "changed"
                    elif how == 1:
                        cut.insert(j, "added")
                    else:
                        del cut[j]
            text = " ".join(cut)
            body.insert(r.randrange(len(body) + 1), text.upper() if d % 3 == 0 else text.replace(" ", "  \n> ") if d % 3 == 1 else text)
        docs.append((d, ". ".join(body)))
    return docs, items, truth


def test_found_equals_the_planted_and_the_exhaustive(spark, corpus):
    docs, items, truth = corpus
    rows = spark.createDataFrame([(k, " ".join(p), " ".join(q), "answer") for k, (p, q) in items.items()], "eval_id bigint, passage string, question string, doc string")
    extra = [(1000, None), (1001, ""), (None, " ".join(items[1][0])), (1002, " ".join(passage(random.Random(99), 3000)) + " " + " ".join(items[2][0]))]
    out = leaks(spark.createDataFrame(docs + extra, "doc_id bigint, text string"), "doc_id", "text", rows, "eval_id", ["passage", "question"]).collect()
    got = {(r.doc_id, r.eval_id) for r in out}
    exhaustive = set()
    texts = {d: words(t) for d, t in docs}
    for k, parts in items.items():
        for p in parts:
            exhaustive |= {(d, k) for d, t in texts.items() if len(set(t) & set(p)) > 8 and excerpt_words(t, p, edits=8) >= LEAST}
    assert truth <= got and got == exhaustive | {(1002, 2)}
    assert (1002, 2) in got


def test_empty_inputs(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, None), (2, "too short"), (None, "x")], "eval_id bigint, passage string")
    assert leaks(docs, "doc_id", "text", items, "eval_id", ["passage"]).count() == 0
    assert leaks(docs.limit(0), "doc_id", "text", items.limit(0), "eval_id", ["passage"]).count() == 0


def test_repeated_items_and_documents(spark, corpus):
    text = " ".join(passage(random.Random(5)))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, text), (7, text), (8, text)], "eval_id bigint, passage string")
    assert sorted((r.doc_id, r.eval_id) for r in leaks(docs, "doc_id", "text", items, "eval_id", ["passage"]).collect()) == [(1, 7), (1, 8), (2, 7), (2, 8)]


def test_edits_that_crowd_every_short_window_are_found(spark):
    own = {k: [f"w{k}x{j}" for j in range(n)] for k, n in enumerate((18, 18, 24, 24, 40))}
    edits = {0: (5, 8, 11), 1: (4, 7, 10), 2: (6, 9, 12, 15), 3: (7, 10, 13, 16), 4: (16, 19, 22)}
    docs = []
    for k, item in own.items():
        lo, hi = (11, 29) if k == 4 else (0, len(item))
        docs.append((k, " ".join(["before"] * 7 + ["other" if j in edits[k] else item[j] for j in range(lo, hi)] + ["after"] * 7)))
        # the shared words are common, so all broken shingles are rarer
        docs += [(100 * (k + 1) + n, " ".join(item[a : a + 5])) for n in range(3) for a in range(0, len(item) - 4, 3)]
    items = spark.createDataFrame([(k, " ".join(w)) for k, w in own.items()], "eval_id bigint, question string")
    got = {(x.doc_id, x.eval_id) for x in leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", items, "eval_id", ["question"]).collect()}
    assert got == {(k, k) for k in own}


def test_every_excerpt_fills_a_span():
    from itertools import combinations

    from ridgeline.llm.leakage import SHINGLE, spans

    def filled(length, broken):
        return any(
            sum(a + k not in broken for k in range(n - SHINGLE + 1)) >= n - SHINGLE + 1 - (p - 2)
            for n, p in spans() if n <= length for a in range(length - n + 1)
        )

    for length, n in ((15, 2), (18, 3), (21, 3), (24, 4), (25, 4)):
        for at in combinations(range(length), n):
            assert filled(length, {x - k for x in at for k in range(SHINGLE)})
    r = random.Random(3)
    for _ in range(3000):
        n = r.randint(5, 14)
        length = n * EDIT + r.randrange(EDIT)
        assert filled(length, {x - k for x in r.sample(range(length), n) for k in range(SHINGLE)})
