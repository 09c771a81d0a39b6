"""Language models, near duplicates, repeated passages, packing and license scans."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fundspark.llm import langid, licenses, neardup, packing, repeats
from fundspark.llm import queries_text as queries
from fundspark.llm.texts import WordHashes, shingle_set

from .conftest import ODD, words

PARTS = st.lists(st.integers(1, 50), min_size=1, max_size=60)


# --- language


@pytest.fixture(scope="module")
def predicted(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = {r.doc_id: r for r in queries.op3_language(spark, SMALL).collect()}
    return found, {r.doc_id: r for r in docs.collect()}


def test_held_out_accuracy(predicted):
    found, docs = predicted
    assert set(found) == set(docs)
    held = [k for k in found if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(found[k].held_out == (k in set(held)) for k in found)
    right = sum(found[k].lang_pred == docs[k].lang for k in held)
    assert right >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in found.values())
    assert sum(r.rejected for r in found.values()) <= 0.03 * len(found)


def test_limits_cover_all_lengths_and_rest_on_all_texts(make):
    docs = make([(i, words(i, 1 + i % 90, 60), ("en", "xx")[i % 5 == 0]) for i in range(3000)] + [(-1, "q z " * 9, "rare")])
    known = langid.fit(docs, docs.filter("lang <> 'rare'"), sample_chars=20_000)
    assert set(known.limits) == {(name, c) for name in ("en", "rare", "xx") for c in range(langid.CLASSES)}
    strange = make([(1, "жщ " * 300_000), (2, "ж"), (3, "qzj " * 40_000)])
    assert all(r.rejected for r in known.predict(strange).collect())
    # Texts beyond any sample of 500 characters lift the limit.
    plain = docs.filter("lang = 'en'")
    more = plain.unionByName(make([(9000 + i, "жщ " * (1 + i % 90), "en", None, None) for i in range(900)]))
    first, second = (langid.fit(plain, rows, sample_chars=500).limits for rows in (plain, more))
    assert all(second[k] > first[k] for k in first)


def test_every_language_is_sampled_within_the_bound(make):
    """One huge text, one text in many copies and ordinary texts: each gives about its share."""
    docs = make(
        [(1, words(1, 200_000), "huge", None, None)]
        + [(10 + i, "abc def ghi " * 250, "copies", None, None) for i in range(300)]
        + [(1000 + i, words(i, 300), "usual", None, None) for i in range(300)]
    )
    found = defaultdict(int)
    for r in langid._sample(docs.select("lang", "text"), 100_000).collect():
        found[r.lang] += len(r.text)
    assert found["copies"] == 3000
    assert all(70_000 < found[name] < 130_000 for name in ("huge", "usual"))
    assert set(langid.fit(docs, docs, 100_000).models.languages) == {"copies", "huge", "usual"}


@given(st.text(st.sampled_from("ab é日."), max_size=60).map(lambda t: t * 60))
@settings(max_examples=50, deadline=None)
def test_pieces_make_up_the_text(text):
    parts = [langid.borders(text, i) for i in range(-(-len(text) // langid.PIECE_CHARS))]
    assert "".join(text[low:high] for low, high in parts) == text


def test_thin_classes_are_pooled():
    found = langid.pools({0: 5, 2: 2000, 3: 400, 4: 700}, 1000)
    assert found[2] == (2, 2) and found[0] == (0, 2) and found[3] == (2, 4)
    assert found[15][0] <= 4 and set(found) == set(range(langid.CLASSES))
    assert set(langid.pools({1: 3}, 1000).values()) == {(0, langid.CLASSES - 1)}


def test_models_are_distributions():
    fitted = langid.fit_language({"abab": 3, "ba": 2, "c": 1})
    for context in ("", "a", " a", "ab"):
        listed = sum(np.exp(p) for g, (p, _) in fitted.items() if p is not None and g[:-1] == context)
        assert 0 < listed <= 1 + 1e-9
    assert abs(sum(np.exp(p) for g, (p, _) in fitted.items() if len(g) == 1 and p is not None) + np.exp(fitted[""][1]) * (1 - 4 / langid.ALPHABET) - 1) < 1e-9


def test_scores_equal_a_direct_evaluation():
    tables = {"x": langid.fit_language({"banana": 2, "band": 1}), "y": langid.fit_language({"nab": 1, "dab": 4})}
    models = langid.Models(tables)
    text = "Banana-dab q bandana"
    sizes, entropy = models.entropies([text, "", "12"])

    def log_p(table, gram):
        if not gram:
            return -np.log(langid.ALPHABET)
        own = table.get(gram, (None, None))[0]
        return own if own is not None else (table.get(gram[:-1], (None, None))[1] or 0.0) + log_p(table, gram[1:])

    for at, name in enumerate(models.languages):
        grams = [s[max(0, i - 4) : i + 1] for w in langid.words_in(text) if w for s in [f" {w} "] for i in range(1, len(s))]
        assert sizes[0] == len(grams)
        assert abs(entropy[0, at] + np.mean([log_p(tables[name], g) for g in grams])) < 1e-5
    assert list(sizes[1:]) == [0, 0]


def test_language_of_odd_tables(spark, make):
    docs = make(ODD + [(30 + i, words(i, 60), ("en", "de", None)[i % 3]) for i in range(30)]).withColumn("score", F.lit("x"))
    found = queries.identifier(docs).predict(docs).collect()
    assert len(found) == len(ODD) + 30
    assert all((r.lang_pred, r.score, r.rejected) == ("und", 0.0, True) for r in found if r.doc_id in (1, 2, 3))
    unlabelled = queries.identifier(docs.limit(0)).predict(docs)
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
    assert queries.identifier(docs).predict(docs.limit(0)).count() == 0


# --- near duplicates


def brute_classes(rows, threshold=0.8):
    known = WordHashes()
    sets = [set(shingle_set(t or "", known).tolist()) for _, t in rows]
    parent, links = list(range(len(rows))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both >= threshold * (len(sets[i] | sets[j])):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[find(i)].append(key)
    return sorted((key, min(least[find(i)]), links[i]) for i, (key, _) in enumerate(rows))


def edited(seed, n, changes):
    out = words(seed, n).split()
    for c in range(changes):
        out[(c * 37 + seed) % n] = f"new{seed}{c}"
    return " ".join(out)


@pytest.mark.parametrize("block", [2048, 7])
def test_classes_equal_brute_force(make, block):
    base = words(1, 200).split()
    rows = [(i, " ".join(base[:k] + [f"v{i}"] + base[k + 1 :])) for i, k in enumerate(range(0, 200, 8))]
    rows += [(100 + i, " ".join(base)) for i in range(5)] + [(200 + i, edited(2, 150, i)) for i in range(8)]
    rows += [(300 + i, words(300 + i, 80)) for i in range(10)] + [r for r in ODD if r[0] is not None]
    found = neardup.similarity_classes(make(rows).withColumn("root", F.lit(1)).withColumn("label", F.lit("x")), block=block)
    assert sorted(map(tuple, found.collect())) == brute_classes(rows)


def test_classes_of_rows_without_key_and_of_no_rows(make):
    found = neardup.similarity_classes(make(ODD)).collect()
    assert len(found) == len(ODD)
    assert neardup.similarity_classes(make([])).count() == 0


def test_prefixes_are_shortened_to_the_recall():
    depth = neardup.shortened(0.8)
    assert neardup.recall(0.8, neardup.TREES, depth) >= neardup.RECALL > neardup.recall(0.8, neardup.TREES, depth + 1)
    with pytest.raises(ValueError):
        neardup.shortened(0.8, trees=2)


# --- repeated passages


def brute_removed(rows):
    rows = [(repeats._NO_ID if k is None else k, (t or "").encode()) for k, t in rows]
    first = {}
    for key, text in rows:
        for s in range(len(text) - 49):
            first[text[s : s + 50]] = min(key, first.get(text[s : s + 50], key))
    out = []
    for key, text in rows:
        gone = bytearray(len(text))
        for s in range(len(text) - 49):
            if first[text[s : s + 50]] < key:
                gone[s : s + 50] = b"\1" * 50
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(text)))
        out.append((key, len(text), sum(gone), spans, bytes(c for c, g in zip(text, gone) if not g)))
    return sorted(out)


def test_removal_equals_brute_force(make):
    shared, line = words(50, 40), "x" * 49
    rows = [(i, words(i, 60) + " " + shared[i:] + " " + words(i + 1, 20)) for i in range(25)]
    rows += [(40, shared), (41, shared), (42, line), (43, line), (44, line + "y" + line), (45, "z" + line + "y" + line), (46, "ab" * 200), (47, "ab" * 90)]
    rows += [(60, "é" * 60), (61, "é" * 80), (61, "é" * 80), (62, shared[:55]), (63, "q" + shared[3:53])] + ODD
    docs = make(rows, parts=8).withColumn("spans", F.lit("clash")).withColumn("bucket", F.lit(2))
    found = repeats.remove_repeats(docs)
    assert set(found.columns) == {"doc_id", "lang", "source", "n_chars", "bucket", "n_bytes", "n_removed", "spans", "kept"}
    ours = sorted(
        (repeats._NO_ID if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in found.collect()
    )
    assert ours == brute_removed(rows)
    assert repeats.remove_repeats(make([])).count() == 0


def test_buckets_of_anchor_hashes_are_even(make):
    docs = make([(i, words(i, 3000)) for i in range(8)], parts=1).select("doc_id", "text")
    (row,) = repeats._chunks(docs).collect()
    keys, place, _ = repeats.Chunk(bytes(row.blob)).keys()
    held = np.diff(repeats._in_buckets(keys, 16))
    assert len(keys) > 5000 and held.sum() == len(keys) == place.max() + 1
    assert held.max() < 1.5 * held.mean()


def test_keys_of_other_chunks_are_found_in_every_bucket(make, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 2000)
    rows = [(i, words(i % 6, 300)) for i in range(9)] + [(20, None), (21, "short")]
    chunks = repeats._chunks(make(rows, parts=2).select("doc_id", "text")).collect()
    keys = {r.chunk: repeats.Chunk(bytes(r.blob)).keys()[0] for r in chunks}
    frame = make([(r.chunk, r.blob) for r in chunks], "chunk bigint, blob binary")
    total = Counter(k for found in keys.values() for k in found.tolist())
    for r in repeats._repeated_keys(frame, 7).collect():
        cuts = repeats._in_buckets(keys[r.chunk], 7)
        for bucket, bits in r.seen:
            here = keys[r.chunk][cuts[bucket] : cuts[bucket + 1]]
            often = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(here))
            assert often.tolist() == [total[k] > 1 for k in here.tolist()]
    assert len(chunks) > 5 and 0 < sum(n > 1 for n in total.values()) < len(total)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(min_size=9, max_size=9).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=40))
def test_multikey_order_sorts_bytes(rows):
    data = np.array([list(r) for r in rows], dtype=np.uint8)
    order = repeats.multikey_order(repeats.as_words(data))
    assert [rows[i] for i in order] == sorted(rows)


# --- packing


def test_packing_of_all_documents(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held, places = defaultdict(dict), defaultdict(list)
    for r in queries.op7_packing(spark, SMALL).collect():
        held[r.doc_id][r.piece] = r
        places[r.sequence_id].append((r.offset, r.length))
    assert set(held) == set(docs)
    for key, text in docs.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for i in range(len(held[key])):
            r = held[key][i]
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == packing.CAPACITY or i == 0
            at += r.length
        assert at == len(ids) and (len(held[key]) == 1 or len(ids) > packing.CAPACITY)
    total = 0
    for place in places.values():
        end = 0
        for offset, length in sorted(place):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
        total += end
    assert len(places) <= -(-total // packing.CAPACITY) + 1


def test_workers_keep_no_runs_when_a_task_ends(spark, make):
    path = queries.tokenizer_path()
    docs = make([(i, words(i, 50)) for i in range(20)], parts=4)
    assert packing.tokenised(docs, path).count() == 20

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(packing.byte_tokens(path))], pa.int64())})

    assert {r.n for r in spark.range(8, numPartitions=4).mapInArrow(held, "n bigint").collect()} == {0}


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "x\n\ny z\n", "don't 'tis it's.", "a b c", "1.5 a1 b-2; c: d!", "\n", "tab\tx y\r\n z", "日本 語。 x.", "<|endoftext|> a", "a.\nB c"])
def test_tokens_by_runs_are_the_tokenizer_s(text):
    known = packing.byte_tokens(queries.tokenizer_path())
    assert packing.token_bytes(text, known) == known.encode(text)


@settings(max_examples=60, deadline=None)
@given(PARTS)
def test_bound_and_best_fit(lengths):
    bins = packing.best_fit(np.array(lengths), 50)
    filled = np.bincount(bins, weights=lengths)
    bound = packing.lower_bound(np.bincount(lengths, minlength=51))
    assert filled.max() <= 50 and bound <= len(filled) <= max(bound + 1, 11 / 9 * bound + 1)


def test_bound_beats_the_total_length():
    assert packing.lower_bound(np.bincount([26] * 10, minlength=51)) == 10


def test_partitions_exchange_what_leaves_gaps(spark):
    rows = [(i, 1 + (i * 7919) % 50) for i in range(3000)]
    items = spark.createDataFrame(rows, "doc_id bigint, length bigint").withColumn("offset", F.lit("clash"))
    found = packing.pack(items, 50, partition_pieces=100).collect()
    assert sorted(r.doc_id for r in found) == list(range(3000))
    alone = packing.pack(items, 50, partition_pieces=3000).select("sequence_id").distinct().count()
    assert alone == -(-sum(n for _, n in rows) // 50) and len({r.sequence_id for r in found}) <= 1.05 * alone


def test_sequences_hold_the_tokens(make):
    docs = make([(1, words(1, 3000)), (2, "one two"), (3, None), (3, None), (4, words(4, 90))])
    packed = packing.pack(packing.tokenised(docs, queries.tokenizer_path()))
    known = packing.byte_tokens(queries.tokenizer_path())
    end = bytes(4)
    held, found = defaultdict(dict), {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert found[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
        held[r.doc_id][r.piece] = bytes(r.ids)
    for r in docs.collect():
        assert b"".join(held[r.doc_id][i] for i in sorted(held[r.doc_id])) == (known.encode(r.text) if r.text else b"") + end
    assert sum(map(len, found.values())) == 4 * sum(r.length for r in packed.collect())


def test_packing_of_odd_and_empty_tables(make):
    pieces = packing.pack(packing.tokenised(make(ODD), queries.tokenizer_path())).collect()
    assert sorted(str(k) for k, _ in ODD) == sorted(str(r.doc_id) for r in pieces if r.piece == 0)
    assert packing.pack(packing.tokenised(make([]), queries.tokenizer_path())).count() == 0


# --- licenses


def test_scan_equals_brute_force(spark, make):
    notices = spark.createDataFrame(licenses.NOTICES, "license string, text string")
    listed = sorted(licenses.NOTICES)
    rows = [(i, f"{words(i, 11 + i)} {text.upper()}. {words(i + 50, 9)}") for i, (_, text) in enumerate(listed)]
    rows += [(20, listed[0][1] + " " + words(1, 30) + " " + listed[0][1]), (21, " ".join(listed[4][1].split()[:9])), (22, words(5, 500))]
    found = licenses.scan(make(rows + ODD).withColumn("license", F.lit("clash")), notices).collect()
    known = WordHashes()
    wanted = [set(licenses.shingles(t, known).tolist()) for _, t in listed]
    expected = Counter()
    for key, text in rows:
        hashes = licenses.shingles(text, known).tolist()
        for t, held in enumerate(wanted):
            runs = [s for s in range(len(hashes)) if len(held & set(hashes[s : s + len(held)])) >= 0.8 * len(held)]
            if runs:
                expected[key, t] = 1 + sum(b - a > len(held) for a, b in zip(runs, runs[1:]))
    assert Counter((r.doc_id, r.template) for r in found) == expected
    by_key = {(r.doc_id, r.template): r for r in found if r.doc_id < 9}
    for i, (name, text) in enumerate(listed):
        r = by_key[i, i]
        assert (r.license, r.first_word, r.containment) == (name, 11 + i, 1.0)
    assert licenses.scan(make([]), notices).count() == 0 and licenses.scan(make(rows), notices.limit(0)).count() == 0


def test_bands_guarantee_the_probability():
    bands = licenses.bands_needed([5, 8], 8, 0.8, 0.9999)
    worst = min(4 / (16 + 5 - 4), 7 / (16 + 8 - 7))
    assert 1 - (1 - worst) ** bands >= 0.9999
