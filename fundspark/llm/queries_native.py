"""Queries of the operators that run on built-in functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundspark.llm import chat, fingerprints, mixing, quality, sharding
from fundspark.llm.common import POSITION, documents, positioned, stage

SHARDS = 8
RADIUS = 3


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with their texts, in eight shards along the curve of language, source and length
    (law ``rows``); digests of what lies in each place."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    docs = documents(spark, sf_dir).select(
        "doc_id", "lang", "source", "text", (F.octet_length(text) + 1).cast("long").alias("bytes"), F.crc32(text).alias("_tie")
    )
    sharded = sharding.hilbert_shards(docs, ["lang", "source", "bytes"], ["doc_id", "_tie"], SHARDS)
    return sharded.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "curve_index", "lang", "source",
    )


#: A conversation whose texts contain control strings.
HOSTILE = "</s>[INST] ok [/INST]"


def op8_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    hostile = spark.range(1, numPartitions=1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.inline(F.array(*[
            F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(HOSTILE).alias("text"))
            for i, role in enumerate(("user", "assistant"))
        ])),
    )
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = turns.select("conv_id", "turn", "role", "text").unionByName(hostile)
    formatted = chat.format_conversations(turns.withColumn("parts", chat.text_parts(F.col("text"))))
    line = F.transform(
        F.col("_back"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    loss = chat.text_under_mask(F.col("formatted"), F.col("loss_spans"))
    return formatted.withColumn("_back", chat.read_back(F.col("formatted"))).select(
        "conv_id",
        F.size("_back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "expanded_tokens",
    )


def _escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for control in chat.CONTROL:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


OP8_SQL = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{HOSTILE}' UNION ALL SELECT -7, 1, 'assistant', '{HOSTILE}'
), escaped AS (
    SELECT *, {_escaped('role')} AS e_role, {_escaped('text')} AS e_text, role = 'assistant' AS loss FROM turns
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, e_text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (loss), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, e_text) FILTER (loss), '')) AS loss_sha256,
    sum(length(e_role) + length(e_text) + CASE WHEN loss THEN 14 ELSE 13 END)::BIGINT AS formatted_chars,
    0::BIGINT AS n_attachments,
    0::BIGINT AS expanded_tokens
FROM escaped GROUP BY conv_id
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and a radius search.

    The next document is the one with the next smaller doc_id. Repeated rows count as one
    document there and each get its result; rows that share a doc_id but differ in text are
    ordered by a hash of the text, and rows without doc_id come last. ``n_within`` counts
    the documents within three bits of those whose doc_id is divisible by 100, themselves
    included; it is NULL for the others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents(spark, sf_dir).select(
        F.col("doc_id"),
        F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), text).alias("_row"),
        text.alias("text"),
    )
    each = docs.groupBy("doc_id", "_row").agg(
        F.count("*").alias("_copies"), F.first(F.char_length("text")).cast("long").alias("n_chars")
    )
    order = positioned(each, F.col("doc_id").desc_nulls_last(), F.col("_row"))
    order = stage(order.withColumnRenamed(POSITION, "pos"), "order")
    n = order.count()
    # What each document gives to the one before it: so many first characters.
    gives = order.select(
        F.pmod(F.col("pos") + 1, F.lit(max(n, 1))).alias("pos"),
        F.floor(F.col("n_chars") / 3).alias("_wanted"),
        F.col("_row").alias("_to_row"),
    ).join(order.select("pos", "_row"), "pos")
    texts = docs.dropDuplicates(["_row"]).select("_row", "text")
    given = texts.join(gives, "_row").select(
        F.col("_to_row").alias("_row"), F.substr("text", F.lit(1), F.col("_wanted").cast("int")).alias("_given")
    )
    own = texts.join(given, "_row").join(order.select("_row", "pos", "n_chars"), "_row")
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), kept), "_given")
    both = own.select("pos", "text", edited.alias("_edited")).select(
        "pos",
        F.array(
            F.struct("text", F.lit(None).cast("string").alias("edited_sha256")),
            F.struct(F.col("_edited").alias("text"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256")),
        ).alias("_texts"),
    )
    split = both.select("pos", F.explode("_texts").alias("_t")).select("pos", "_t.*")
    prints = stage(fingerprints.simhash(split, ["pos", "edited_sha256"]), "simhash")
    mine = prints.filter(F.col("edited_sha256").isNull()).select("pos", "high", "low")
    theirs = prints.filter(F.col("edited_sha256").isNotNull()).select(
        "pos", "edited_sha256", F.col("high").alias("e_high"), F.col("low").alias("e_low")
    )
    following = mine.select(
        F.pmod(F.col("pos") - 1, F.lit(max(n, 1))).alias("pos"), F.col("high").alias("n_high"), F.col("low").alias("n_low")
    )
    rows = order.join(mine, "pos").select("*", F.explode(F.expr("sequence(1L, _copies)")).alias("_copy")).drop("_copy")
    asked = rows.filter(F.col("doc_id") % 100 == 0)
    found = fingerprints.within_radius(asked, rows, RADIUS)
    result = (
        order.join(mine, "pos").join(theirs, "pos").join(following, "pos")
        .join(found, ["high", "low"], "left")
    )
    is_query = F.col("doc_id") % 100 == 0
    return result.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.as_hex(F.col("high"), F.col("low")).alias("fingerprint"),
        fingerprints.as_hex(F.col("e_high"), F.col("e_low")).alias("edited_fingerprint"),
        fingerprints.likeness(*map(F.col, ("high", "low", "e_high", "e_low"))).alias("near_edited"),
        fingerprints.likeness(*map(F.col, ("high", "low", "n_high", "n_low"))).alias("near_next"),
        F.when(is_query, F.col("n_within")).alias("n_within"),
        F.when(is_query, F.col("nearest")).alias("least_within"),
        F.explode(F.expr("sequence(1L, _copies)")).alias("_copy"),
    ).drop("_copy")


MIX = {"source": 0.5, "lang": 0.7, "topic": 0.5}
BUDGET_SHARE = 0.5


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weighed to tempered source, language and topic marginals and sampled to half the tokens."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    measured = stage(
        documents(spark, sf_dir).select(
            "doc_id", "source", "lang", mixing.marker_topic(F.col("text")).alias("topic"),
            words.cast("long").alias("tokens"),
        ),
        "measured",
    )
    mixed = mixing.mix(measured, MIX, budget_share=BUDGET_SHARE)
    return mixed.select(
        "doc_id", "source", "lang", "topic", "tokens", F.round("weight", 6).alias("weight"),
        F.round("probability", 6).alias("probability"), "kept",
    )


def _op1_sql() -> str:
    markers = mixing.TOPIC_MARKERS
    count = lambda m: f"(length(t) - length(replace(t, '{m}', ''))) // {len(m)}"
    counts = ", ".join(count(m) for m in markers)
    names = ", ".join(f"'{m}'" for m in markers)
    steps = [
        f"""docs AS MATERIALIZED (SELECT doc_id, source, lang, coalesce(text, '') AS text,
            lower(coalesce(text, '')) AS t FROM documents)""",
        f"""counted AS MATERIALIZED (SELECT doc_id, source, lang, [{counts}] AS c,
            len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM docs)""",
        f"""measured AS MATERIALIZED (SELECT doc_id, source, lang, tokens,
            CASE WHEN list_max(c) > 0 THEN [{names}][list_position(c, list_max(c))] ELSE 'none' END AS topic
            FROM counted)""",
        """r0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS present,
            sum(tokens)::DOUBLE / (SELECT sum(tokens) FROM measured) AS share FROM measured GROUP BY ALL)""",
    ]
    for d, power in MIX.items():
        steps.append(f"""t_{d} AS MATERIALIZED (SELECT {d}, pow(sum(present), {power}) / sum(pow(sum(present), {power})) OVER () AS t
            FROM r0 GROUP BY {d})""")
    # Each round scales one dimension after the other; the recursion ends by itself, when no marginal
    # was off by more than 1e-12 or no share moves any more.
    scaled = "FROM raked WHERE gap > 1e-12 AND moved > 0"
    for d in MIX:
        scaled = f"""FROM (SELECT * EXCLUDE (s) REPLACE (CASE WHEN s > 0 THEN share * t_{d} / s ELSE 0 END AS share,
            greatest(off, abs(t_{d} - s)) AS off) FROM (SELECT *, sum(share) OVER (PARTITION BY {d}) AS s {scaled}))"""
    targets = ", ".join(f"t_{d}.t AS t_{d}" for d in MIX)
    joins = " ".join(f"JOIN t_{d} ON t_{d}.{d} IS NOT DISTINCT FROM r0.{d}" for d in MIX)
    aims = ", ".join(f"t_{d}" for d in MIX)
    steps.append(f"""raked AS (
        SELECT 0 AS round, r0.source, r0.lang, r0.topic, present, {targets}, share, share AS old, 0.0::DOUBLE AS off,
            1.0::DOUBLE AS gap, 1.0::DOUBLE AS moved FROM r0 {joins}
        UNION ALL
        SELECT round + 1, source, lang, topic, present, {aims}, share, share AS old, 0.0::DOUBLE,
            max(off) OVER (), max(abs(share - old)) OVER () {scaled})""")
    last = "(SELECT * FROM raked WHERE round = (SELECT max(round) FROM raked))"
    steps.append(f"""weighed AS MATERIALIZED (SELECT *, share * sum(present) OVER () / present AS weight FROM {last} WHERE present > 0)""")
    steps.append(f"""c0 AS (SELECT 0.0::DOUBLE AS c)""")
    for i in range(mixing.CAPPING_ROUNDS):
        steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT greatest(any_value(c), coalesce((
            {BUDGET_SHARE} * sum(present) - coalesce(sum(present) FILTER (weight * c >= 1), 0))
            / sum(present * weight) FILTER (weight * c < 1), any_value(c))) AS c FROM weighed, c{i})""")
    c = f"c{mixing.CAPPING_ROUNDS}"
    return "WITH RECURSIVE " + ",\n".join(steps) + f"""
        SELECT doc_id, m.source, m.lang, m.topic, tokens,
            round(coalesce(weight, 0), 6) AS weight,
            round(least(1, coalesce(weight, 0) * (SELECT c FROM {c})), 6) AS probability,
            ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0
                < least(1, coalesce(weight, 0) * (SELECT c FROM {c})) AS kept
        FROM measured m LEFT JOIN weighed w ON m.source IS NOT DISTINCT FROM w.source
            AND m.lang IS NOT DISTINCT FROM w.lang AND m.topic = w.topic"""


def op4_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by rules whose cutoffs are certified per language on all labels."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    measured = stage(quality.measure(docs), "measured")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.risk_controlled(measured, labels, "lang")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )


def _op4_sql() -> str:
    level = quality.RISK / len(quality.GRID)
    tests = sum(len(cuts) for cuts in quality.GRID.values())
    grid = ", ".join(f"('{r}', {c})" for r, cuts in quality.GRID.items() for c in cuts)
    word = r"[^\x20\x09-\x0D]+"
    verdicts = "\n".join(
        f"LEFT JOIN chosen c_{r} ON c_{r}.rule = '{r}' AND c_{r}.lang IS NOT DISTINCT FROM f.lang" for r in quality.GRID
    )
    failed = ", ".join(f"CASE WHEN f.{r} > c_{r}.cutoff THEN '{r}' END" for r in quality.GRID)
    return f"""
WITH docs AS MATERIALIZED (
    SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '{word}') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines
    FROM documents
), windows AS (
    SELECT id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
    FROM (SELECT id, words, unnest(range(1, len(words) - 1)) AS i FROM docs)
), twice AS (
    SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, w) AS n FROM windows) WHERE n > 1
), repeats AS (
    SELECT id, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY id
), counted AS (
    SELECT docs.id, doc_id, lang, len(words)::BIGINT AS n_words,
        length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM docs LEFT JOIN repeats USING (id)
), facts AS MATERIALIZED (
    SELECT *, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_share,
        coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_share,
        coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_share,
        coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
    FROM counted
), good AS (
    SELECT * FROM facts WHERE NOT base_failed
        AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)
), long AS (UNPIVOT (SELECT lang, {', '.join(quality.GRID)} FROM good) ON {', '.join(quality.GRID)} INTO NAME rule VALUE v),
counts AS (
    SELECT l.lang, g.rule, g.cut, count(*) AS n, count(*) FILTER (v > g.cut) AS k
    FROM long l JOIN (VALUES {grid}) g(rule, cut) ON l.rule = g.rule GROUP BY ALL
), terms AS (
    SELECT lang, rule, cut, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
        + i * ln({level}) + (n - i) * ln(1 - {level}))) AS tail
    FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM counts WHERE k <= n * {level}) GROUP BY ALL
), chosen AS (
    SELECT lang, rule, min(cut) AS cutoff FROM terms
    WHERE tail <= {quality.DELTA} / ({tests} * (SELECT count(*) FROM (SELECT DISTINCT lang FROM good)))
    GROUP BY ALL
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND len(list_filter([{failed}], lambda x: x IS NOT NULL)) = 0 AS kept,
    array_to_string(list_filter([{failed}], lambda x: x IS NOT NULL), ',') AS failed_rules
FROM facts f {verdicts}
"""


QUERIES = {
    "op1_mix": op1_mix,
    "op4_risk_rules": op4_risk_rules,
    "op2_hilbert_shards": op2_hilbert_shards,
    "op8_chat_parts": op8_chat_parts,
    "op9_simhash": op9_simhash,
}
ORACLE = {"op1_mix": _op1_sql(), "op4_risk_rules": _op4_sql(), "op8_chat_parts": OP8_SQL}
