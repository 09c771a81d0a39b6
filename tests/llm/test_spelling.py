"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from fundspark.llm import queries_text as queries
from fundspark.llm import spelling

from .conftest import DOCS, ODD


def edited(key, run):
    run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
    h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run


def near(word):
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in letters} | {
        a + c + b for a, b in cut for c in letters
    } - {word}


def brute(rows):
    counts = Counter(edited(k, r) for k, t in rows for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    around = {w: [x for x in near(w) if x in counts and x != w] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(around[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(around[w]), counts[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("rare", [0, 3, 30])
def test_equals_all_pairs(make, rare):
    draw = random.Random(rare)
    stems = ["".join(draw.choice("abné") for _ in range(draw.randrange(4, 11))) for _ in range(250)]
    rows = []
    for i in range(60):
        text = " ".join(draw.choice(stems[: 20 + 4 * i]) + draw.choice(["", "", "s", "a", "É"]) for _ in range(200))
        rows.append((i, text + " ×÷xyzé AÀBcD_" * 3))
    rows += [(100 + i, "chain chains chainss chainsss " * 3 ** (4 - i) + "chain " * 400) for i in range(4)]
    docs = make(rows)
    found = {tuple(r) for r in spelling.variants(docs, rare=rare, frequent=100 if rare == 3 else 5000).select(
        "word", "form", "root", "n", "n_near", "form_n").collect()}
    wanted = brute(rows)
    assert found == wanted and sum(r[4] > 0 for r in wanted) > 50 and any(r[1] != r[2] for r in wanted if r[1])


WORDS = st.text(st.sampled_from("ab"), min_size=5, max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=40), WORDS, st.integers(0, 40), st.sampled_from("abc"), st.integers(0, 4), st.integers(2, 5))
def test_no_edit_changes_more_grams_than_stated(known, word, place, letter, rare, longest):
    """Whatever the edit, the variant keeps the stated number of the word's grams, and they meet."""
    i = place % len(word)
    variants = {word[:i] + word[i + 1 :], word[:i] + letter + word[i + 1 :], word[:i] + letter + word[i:], word + letter} - {word}
    marked = [f"^{w}$" for w in {*known, word, *variants}]
    counts = Counter(m[p : p + size] for m in marked for size in range(2, longest + 1) for p in range(len(m) - size + 1))
    grams = spelling.Grams(
        {g: n for g, n in counts.items() if all(counts[g[:size]] > rare for size in range(2, len(g)))}, longest, rare
    )
    mine, sure = grams.rarest(word)
    whole = Counter(m[1] for m in [(0, f"^{word}$"[p : e + 1]) for p, e in grams.decompose(f"^{word}$")])
    for variant in variants:
        marked = f"^{variant}$"
        other = Counter(marked[p : e + 1] for p, e in grams.decompose(marked))
        assert sum((whole & other).values()) >= sure
        theirs, also = grams.rarest(variant)
        if max(sure, also) >= 1:
            shift = (-1, 0) if len(variant) < len(word) else (0, 1) if len(variant) > len(word) else (0,)
            assert any(g == h and q - p in shift for g, p in mine for h, q in theirs)


def test_odd_rows_and_empty_tables(make):
    rows = [r[:2] for r in ODD] + [(50 + i, "Wörter wörter Wörtern " * 9) for i in range(9)]
    docs = make(rows).withColumnsRenamed({"n_chars": "word", "lang": "n", "source": "form"})
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in spelling.variants(docs).select(*columns).collect()} == brute(rows)
    assert spelling.variants(make([], DOCS)).count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    result = queries.op12_spelling(spark, SMALL)
    assert result.dtypes == [
        ("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")
    ]
    assert {tuple(r) for r in result.collect()} == brute(rows)
