"""Two tokenizers on every text, against both tokenizers themselves."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from fundspark.llm import alignment
from fundspark.llm import queries_text as queries

from .conftest import DOCS, ODD

A, B = queries.tokenizer_path(), queries.tokenizer_path(queries.SECOND_TOKENIZER)


@pytest.fixture(scope="module")
def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def spans(tokenizers, text):
    """(id, first byte, end) of all tokens of the whole text, or None where they do not give it back."""
    a, b = tokenizers
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in printing]
    of = {chr(x): x for x in printing} | {chr(256 + i): x for i, x in enumerate(others)}
    out = []
    whole = (" " + text).encode()
    ids = a.encode(" " + text, add_special_tokens=False).ids
    pieces = b.encode(text, num_threads=1)
    spelled_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids]
    spelled_b = [
        bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        for i in pieces
    ]
    for numbers, spelled in ((ids, spelled_a), (pieces, spelled_b)):
        if b"".join(spelled) != whole:
            return None
        at, found = 0, []
        for i, s in zip(numbers, spelled):
            found.append((i, at, at + len(s)))
            at += len(s)
        out.append(found)
    return out


def brute(tokenizers, texts):
    """The measures of all texts, in their order."""
    texts, per_text, counts = list(texts), {}, Counter()
    for text, copies in Counter(texts).items():
        both = spans(tokenizers, text) if text else None
        if both is None:
            per_text[text] = None
            continue
        first, second = both
        links = [(x, y) for x, s, e in first for y, s2, e2 in second if s < e2 and s2 < e]
        cuts = sorted({e for *_, e in first} & {e for *_, e in second})
        groups, low = [], 0
        for high in cuts:
            sides = (",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in both)
            groups.append("|".join(sides))
            low = high
        per_text[text] = (len(first), len(second), len(groups), links, ";".join(groups))
        counts.update(links * copies)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for text in texts:
        if per_text[text] is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, groups = per_text[text]
        n_best = sum(counts[x] == best[x[1]] for x in links)
        digest = hashlib.sha256(groups.encode()).hexdigest()
        out.append((n_a, n_b, n_groups, len(links), n_best, sum(counts[x] for x in links), digest))
    return out


def check(tokenizers, docs, rows, chunk_bytes):
    found = [tuple(r) for r in alignment.align(docs, A, B, chunk_bytes).collect()]
    wanted = [(k, *m) for (k, _), m in zip(rows, brute(tokenizers, [t for _, t in rows]))]
    assert sorted(found, key=str) == sorted(wanted, key=str)


def test_equals_both_tokenizers(tokenizers, make, spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if r.doc_id is not None]
    rows = [r for r in rows if not r[1] or len(r[1]) < 2500][:60]
    rows += [(1000 + i, rows[5][1]) for i in range(7)] + [
        (2000, "<|endoftext|> </s> <s>[INST] <0x0A> it's  we'll"), (2001, "a ▁ b"), (2002, "\x00 a\x1c b  c \xa0d"),
        (2003, " lead"), (2004, "trail "), (2005, "a\n\n b \t\t c\n"), (2006, "日本 語 \U0001f600\U0001f600 é"), (2007, "<unk> ⁇"),
    ]
    check(tokenizers, make(rows), rows, 3000)


def test_odd_rows_extra_columns_and_empty_tables(tokenizers, make):
    rows = [r[:2] for r in ODD]
    docs = make(rows).withColumnsRenamed({"n_chars": "weight", "lang": "key", "source": "chunk"})
    found = [tuple(r) for r in alignment.align(docs, A, B).collect()]
    assert len(found) == len(rows)
    by_text = dict(zip([t for _, t in rows], [m for m in brute(tokenizers, [t for _, t in rows if t is None or len(t) < 3000])]))
    assert found.count((1, 0, 0, 0, 0, 0, 0, "")) == 1 and by_text[None] == (0, 0, 0, 0, 0, 0, "")
    repeated = [m for m in found if m[0] == 5]
    assert len(repeated) == 2 and repeated[0] == repeated[1]
    assert alignment.align(make([], DOCS), A, B).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab cé▁\n\t'0.<|>日   \x00\x85s"), max_size=40))
def test_runs_are_the_whole(tokenizers, text):
    known = alignment.aligner(A, B)
    cut = alignment.runs_of(text) if text else []
    if unknown := [r for r in dict.fromkeys(cut) if r not in known]:
        known.learn(unknown)
    runs = [known[r] for r in cut]
    both = spans(tokenizers, text) if text else None
    if both is None or None in runs:
        assert both is None and (not text or None in runs)
        return
    assert [sum(r[0] for r in runs), sum(r[1] for r in runs)] == [len(side) for side in both]
    ids = [[i for g in ";".join(r[3] for r in runs).split(";") for i in g.split("|")[side].split(",")] for side in (0, 1)]
    assert ids == [[str(i) for i, *_ in side] for side in both]


def test_long_texts_come_in_segments():
    text = "ab  cd\n ef gh " * 500
    parts = list(alignment.segments(text, 100))
    assert " ".join(parts) == text and max(map(len, parts)) < 130
    assert [r for p in parts for r in alignment.runs_of(p)] == alignment.BORDER.split(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t\x1c\x85\xa0\u2003"), max_size=12))
def test_plain_segments_are_cut_at_the_same_borders(text):
    assert alignment.runs_of(text) == alignment.BORDER.split(text)


@pytest.mark.parametrize("most", [0, 5, 255, 256, 70_000, 2**32 - 1])
def test_packed_numbers_come_back(most):
    numbers = np.array([most, 0, most // 2, 1 if most else 0])
    assert alignment.unpacked(alignment.packed(numbers)).tolist() == numbers.tolist()


def test_known_runs_are_bounded_and_the_frequent_ones_stay(monkeypatch):
    known = alignment.Aligner(A, B)
    monkeypatch.setattr(alignment.Aligner, "LIMIT", 10)
    for i in range(30):
        known.learn([r for r in ("often", f"x{i}", "▁") if r not in known])
        assert len(known) <= 13 and known["▁"] is None and known["often"][0] >= 1


def test_query(spark):
    result = queries.op11_alignment(spark, SMALL)
    assert [d for d in result.dtypes[:8]] == [
        ("doc_id", "bigint"), *[(c, "bigint") for c in alignment.MEASURES], ("groups_sha256", "string")
    ]
    assert result.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
