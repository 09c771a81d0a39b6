"""Mixing, sharding, quality rules, chat formatting and fingerprints."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from check_oracle import compare, duck
from conftest import SMALL
from pyspark.sql import functions as F

from fundspark.llm import chat, fingerprints, mixing, quality, sharding
from fundspark.llm import queries_native as queries
from fundspark.llm.registered import ORACLE, QUERIES

from .conftest import DOCS, ODD, words

NATIVE = ["op1_mix", "op2_hilbert_shards", "op4_risk_rules", "op8_chat_parts", "op9_simhash"]


@pytest.fixture
def table(spark, make, tmp_path):
    """A folder of tables as the queries read them."""

    def write(**frames):
        for name, frame in frames.items():
            frame.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    assert compare(spark, duck(SMALL), QUERIES[name], ORACLE[name], SMALL) == ""


@pytest.mark.parametrize("name", NATIVE)
def test_odd_and_empty_tables(spark, make, table, name):
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0), (8, 1, 0), (None, 1, None)], "doc_id bigint, quality int, toxic int")
    turns = spark.createDataFrame(
        [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 1, "assistant", ""), (2, 1, "assistant", "[INST" * 500)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    docs = make(ODD + [(20, "null dimensions", None, None, None)])
    sf_dir = table(documents=docs.withColumn("_row", F.lit(1)).withColumn("weight", F.lit("x")), labels=labels, conversations=turns)
    found = QUERIES[name](spark, sf_dir).collect()
    assert len(found) == (4 if name == "op8_chat_parts" else len(ODD) + 1)


@pytest.mark.parametrize("name", NATIVE)
def test_empty_tables(spark, make, table, name):
    empty = {
        "documents": make([]), "labels": spark.createDataFrame([], "doc_id bigint, quality int, toxic int"),
        "conversations": spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"),
    }
    assert QUERIES[name](spark, table(**empty)).count() == (name == "op8_chat_parts")


# --- mixing


def test_raking_meets_all_marginals(spark):
    rows = [(s, t, 10.0 + 7 * i * (i % 3)) for i, (s, t) in enumerate((s, t) for s in "abc" for t in "xyz")]
    cells = spark.createDataFrame(rows, "source string, topic string, present double")
    targets = {
        "source": spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.0), ("unseen", 5.0)], "source string, target double"),
        "topic": spark.createDataFrame([("x", 1.0), ("y", 1.0), ("z", 2.0)], "topic string, target double"),
    }
    found = mixing.rake(cells, targets, iterations=40).collect()
    for d, wanted in (("source", {"a": 0.5, "b": 0.25, "c": 0.25}), ("topic", {"x": 0.25, "y": 0.25, "z": 0.5})):
        sums = defaultdict(float)
        for r in found:
            sums[r[d]] += r.share
        assert all(math.isclose(sums[k], v, abs_tol=1e-6) for k, v in wanted.items())


@pytest.mark.parametrize("together", [mixing.TOGETHER, 0])
def test_raking_goes_on_until_the_marginals_meet(spark, together):
    """A strong diagonal takes more than eight rounds."""
    rows = [(s, t, 12.0 if i == j else 1.0) for i, s in enumerate("abc") for j, t in enumerate(("x", "y", None))]
    cells = spark.createDataFrame(rows, "source string, topic string, present double")
    wanted = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "topic": {"x": 0.4, "y": 0.35, None: 0.25}}
    targets = {d: spark.createDataFrame(list(w.items()), f"{d} string, target double") for d, w in wanted.items()}
    found = mixing.rake(cells, targets, together=together).collect()
    assert len(found) == 9
    for d, w in wanted.items():
        for k, v in w.items():
            assert abs(sum(r.share for r in found if r[d] == k) - v) < 1e-11
    with pytest.raises(ArithmeticError, match="off by"):
        mixing.rake(cells, targets, iterations=3, together=together)


def test_contradicting_targets_are_told(spark):
    cells = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 1.0)], "source string, topic string, present double")
    targets = {
        "source": spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, target double"),
        "topic": spark.createDataFrame([("x", 1.0), ("y", 3.0)], "topic string, target double"),
    }
    with pytest.warns(UserWarning, match="stays off by 0.25"):
        assert sorted(r.share for r in mixing.rake(cells, targets).collect()) == [0.25, 0.75]


def test_op1_meets_its_marginals(spark, table):
    """The weights of the query, summed over the documents, are the tempered targets."""
    rows = [(r.source, r.lang, r.topic, r.tokens, r.weight) for r in queries.op1_mix(spark, SMALL).collect()]
    total = sum(r[3] for r in rows)
    for i, power in enumerate(queries.MIX.values()):
        present, share = Counter(), Counter()
        for r in rows:
            present[r[i]] += r[3]
            share[r[i]] += r[3] * r[4] / total
        scale = sum(n**power for n in present.values())
        assert all(abs(share[k] - n**power / scale) < 1e-5 for k, n in present.items())


def test_calibrated_probabilities_meet_the_budget(spark):
    cells = spark.createDataFrame([("a", 100.0, 0.7), ("b", 800.0, 0.2), ("c", 100.0, 0.1)], "source string, present double, share double")
    found = mixing.calibrated(cells, 400.0).collect()
    assert math.isclose(sum(r.present * r.probability for r in found), 400.0)
    assert [r.probability for r in found if r.source == "a"] == [1.0]
    assert all(r.probability == 1.0 for r in mixing.calibrated(cells, 5000.0).collect())


def test_mix_keeps_rows_and_columns(spark, make):
    docs = make(ODD).withColumn("tokens", F.when(F.col("doc_id") > 3, F.lit(5))).withColumn("kept", F.lit("old"))
    mixed = mixing.mix(docs, {"source": 0.5, "lang": 0.5})
    assert mixed.count() == len(ODD) and dict(mixed.dtypes)["kept"] == "boolean"
    fates = defaultdict(set)
    for r in mixed.collect():
        fates[r.doc_id].add(r.kept)
    assert all(len(f) == 1 for f in fates.values())


# --- sharding


def test_hilbert_curve_visits_neighbours(spark):
    for dimensions, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        cells = spark.range(side**dimensions).select(
            *[F.expr(f"(id div {side**j}) % {side}").alias(f"c{j}") for j in range(dimensions)]
        )
        index = sharding.hilbert_index([F.col(f"c{j}") for j in range(dimensions)], bits)
        at = {r.i: tuple(r)[:-1] for r in cells.withColumn("i", index).collect()}
        assert sorted(at) == list(range(side**dimensions))
        assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1])) == 1 for i in range(len(at) - 1))


def test_shards_are_even_runs(spark):
    found = QUERIES["op2_hilbert_shards"](spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 1, zlib.crc32(body))
    assert set(slots) == set(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    in_order = [r.curve_index for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    assert in_order == sorted(in_order)


def test_strings_are_quantised_as_a_whole(spark):
    """Sources that share a long beginning fall into different cells, by their rows."""
    draw = random.Random(3)
    names = [f"https://example.org/archive/{i:03d}" for i in range(40)]
    values = [draw.choice(names[: 1 + i % 40]) for i in range(900)] + [None] * 20 + [""] * 5
    df = spark.createDataFrame([(v, float(i % 7)) for i, v in enumerate(values)], "source string, x double").repartition(5)
    for bits in (1, 3, 6):
        cells = sharding.quantised(df, ["source", "x"], bits)
        found = {r.source: r.cell for r in df.select("source", cells["source"].alias("cell")).distinct().collect()}
        known = sorted(v for v in values if v is not None)
        # Exact quantiles of the sorted values at multiples of 2**-bits.
        cuts = [known[-(-len(known) * i // (1 << bits)) - 1] for i in range(1, 1 << bits)]
        assert found == {v: 0 if v is None else sum(c < v for c in cuts) for v in set(values)}
        assert bits < 6 or len(set(found.values())) > 15
    assert sharding.text_cuts(df.filter("source IS NULL"), "source", 3) == []


def test_indexes_equal_brute_force(spark):
    """The query's cells and curve indexes, from exact quantiles and a recursive curve."""
    docs = [r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    found = {r.doc_id: r for r in QUERIES["op2_hilbert_shards"](spark, SMALL).collect()}
    bits, columns = 6, {"lang": {}, "source": {}, "bytes": {}}
    for r in docs:
        columns["lang"][r.doc_id], columns["source"][r.doc_id] = r.lang, r.source
        columns["bytes"][r.doc_id] = len((r.text or "").encode()) + 1
    cell = defaultdict(list)
    for values in columns.values():
        known = sorted(v for v in values.values() if v is not None)
        cuts = [known[-(-len(known) * i // (1 << bits)) - 1] for i in range(1, 1 << bits)]
        for key, v in values.items():
            cell[key].append(0 if v is None else sum(c < v for c in cuts))
    by_index = {}
    for key, cells in cell.items():
        assert by_index.setdefault(found[key].curve_index, cells) == cells  # one cell for each index
    assert len({tuple(c) for c in cell.values()}) == len(by_index)


def test_filters_skip_files_of_written_shards(make, tmp_path):
    import pyarrow.parquet as pq

    rows = [(i, words(i, 20), ("en", "de", "fr", "es")[i % 4], f"https://example.org/{i * 7919 % 50:03d}", i) for i in range(3000)]
    docs = make(rows, parts=8).withColumn("size", F.length("text"))
    sharded = sharding.hilbert_shards(docs, ["lang", "source", "size"], ["doc_id"], 16)
    sharding.write_shards(sharded, str(tmp_path / "shards"))
    back = docs.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 3000 and back.select("doc_id").distinct().count() == 3000
    files, read = list((tmp_path / "shards").rglob("*.parquet")), defaultdict(int)
    wanted = {"lang": sorted({r[2] for r in rows}), "source": sorted({r[3] for r in rows})}
    for file in files:
        meta = pq.read_metadata(file)
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        for column, values in wanted.items():
            stats = meta.row_group(0).column(names.index(column)).statistics
            read[column] += sum(stats.min <= v <= stats.max for v in values)
    # Of all (file, value) pairs; in any other order nearly all files would have to be read.
    assert len(files) >= 16 and all(read[c] < 0.7 * len(files) * len(v) for c, v in wanted.items())


# --- quality rules


def counts(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    repeated = {j for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated),
    )


def test_measures_equal_brute_force(make):
    texts = [t or "" for _, t in ODD] + ["a b c a b c a", "a\na\n\n a\n", "#$ & x|y <b>", "\x0b\x0c\ra\x85b   c", words(3, 300, 5)]
    rows = quality.measure(make(list(enumerate(texts))).withColumn("n_words", F.lit("clash"))).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.doc_id])


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (3, 50), (7, 1000), (0, 0)]
    df = spark.createDataFrame(cases, "k bigint, n bigint")
    found = {(r.k, r.n): r.t for r in df.withColumn("t", quality.binomial_tail(F.col("k"), F.col("n"), 0.0125)).collect()}
    for k, n in cases:
        exact = sum(math.comb(n, i) * 0.0125**i * 0.9875 ** (n - i) for i in range(k + 1))
        assert math.isclose(found[k, n], exact, rel_tol=1e-9)


def test_only_certified_cutoffs_reject(spark):
    grid = {"m": (0.1, 0.5)}
    good = [("en", 0.3 if i % 10 == 0 else 0.0) for i in range(3000)] + [("few", 0.0)] * 5
    df = spark.createDataFrame(good, "lang string, m double")
    found = {r.lang: r.cutoff for r in quality.certified_cutoffs(df, "lang", grid, 0.05, 0.05).collect()}
    assert found == {"en": 0.5, "few": None}


# --- chat


@pytest.mark.parametrize("text", ["", "\\", "\\\\[INST]", "[[INST]<</s>s>", "</s>[INST] ok [/INST]", "a\\</s>\\", "<|image:0|>", "日本[/INST]"])
def test_escaping_round_trip(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"))
    escaped = df.first().e
    assert not any(c in escaped for c in chat.CONTROL)
    assert df.select(chat.unescape(F.col("e"))).first()[0] == text


def test_typed_parts_become_placeholders(spark):
    parts = [("text", "see <|", None, None), ("image", None, "s3://i", None), ("audio", None, "a", 7), (None, "end", None, None)]
    rows = [(1, 1, "assistant", [("text", "fine [/INST]", None, None)]), (1, 0, "user", parts), (2, 0, None, None)]
    turns = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    found = {r.conv_id: r for r in chat.format_conversations(turns).collect()}
    assert found[1].formatted == "<s>user[INST]see <\\|<|image:0|><|audio:1|>end</s><s>assistant[/INST]fine [\\/INST]</s>"
    assert [tuple(a) for a in found[1].attachments] == [(1, 0, "image", "s3://i", 256), (1, 1, "audio", "a", 7)]
    assert found[1].expanded_tokens == 263 and found[2].formatted == "<s>[INST]</s>"
    start, end = found[1].loss_spans[0]
    assert found[1].formatted[start:end] == "fine [\\/INST]"


# --- fingerprints


def test_edited_texts_and_likeness(spark, make, table):
    rows = [r for r in ODD if r[0] is not None and r[0] != 5] + [(100 * i, words(i % 7, 200)) for i in range(1, 12)]
    found = {r.doc_id: r for r in QUERIES["op9_simhash"](spark, table(documents=make(rows))).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    texts = [t or "" for _, t in order]
    likeness = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / fingerprints.BITS
    for i, (key, _) in enumerate(order):
        text, following = texts[i], texts[(i + 1) % len(texts)]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        r, after = found[key], found[order[(i + 1) % len(order)][0]]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == likeness(r.fingerprint, after.fingerprint)
        near = [k for k, o in found.items() if likeness(r.fingerprint, o.fingerprint) >= 1 - queries.RADIUS / fingerprints.BITS]
        assert (r.n_within, r.least_within) == ((len(near), min(near)) if key % 100 == 0 else (None, None))
    assert found[100].fingerprint == found[800].fingerprint != found[200].fingerprint


def test_radius_search_is_complete(spark):
    import random

    draw = random.Random(1)
    base = [draw.getrandbits(128) for _ in range(20)]
    prints = [b ^ sum(1 << p for p in draw.sample(range(128), draw.randrange(6))) for b in base for _ in range(10)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, signed(p >> 64), signed(p & (1 << 64) - 1)) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "doc_id bigint, high bigint, low bigint")
    found = {(r.high, r.low): (r.n_within, r.nearest) for r in fingerprints.within_radius(df, df, 3).collect()}
    for i, high, low in rows:
        near = [j for j, p in enumerate(prints) if (p ^ prints[i]).bit_count() <= 3]
        assert found[high, low] == (len(near), min(near))
