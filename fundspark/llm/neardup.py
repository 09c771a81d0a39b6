"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts are sets of hashed runs of five lower-case words. A forest of ``TREES`` prefix tries holds
each set once per tree under a label of MinHash values. Sets that share a prefix in any tree
are candidates; the prefix is shortened from ``MAX_DEPTH`` until a pair at the threshold
meets in some tree with the target probability. Candidate groups are then verified exactly:
they are cut into blocks, and each pair of blocks is one task group that finds all its links by
intersecting the sets themselves. Only link counts and a spanning forest leave the task, so
neither copies nor large groups of near copies are ever expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundspark.llm.common import stage
from fundspark.llm.components import connected
from fundspark.llm.texts import SHINGLE, WordHashes, pieces, shingle_set

THRESHOLD = 0.8
TREES, MAX_DEPTH, RECALL = 40, 12, 0.999
#: Sets that meet another block of as many in one task.
BLOCK = 2048
#: A pair is intersected if its MinHash values agree at least to this share (8 bits each).
#: A pair at the threshold falls below with a probability of about 1e-9.
SCREEN = 0.65
_SEED = 20_240_601


def recall(similarity: float, trees: int, depth: int) -> float:
    """The probability that two sets share a prefix of ``depth`` in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def shortened(threshold: float, trees: int = TREES, depth: int = MAX_DEPTH, target: float = RECALL) -> int:
    """The longest prefix at which the target recall is met, found by shortening the full label."""
    while depth > 1 and recall(threshold, trees, depth) < target:
        depth -= 1
    if recall(threshold, trees, depth) < target:
        raise ValueError("more trees are needed for this recall")
    return depth


def min_hashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """``n`` MinHash values of each non-empty set, one row a set."""
    draw = np.random.default_rng(_SEED)
    flip = draw.integers(0, 1 << 32, n, dtype=np.uint32)
    scale = draw.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]].astype(np.int64)
    out = np.empty((n, len(sets)), dtype=np.uint32)
    work = np.empty_like(values)
    for i in range(n):
        np.bitwise_xor(values, flip[i], out=work)
        np.multiply(work, scale[i], out=work)
        out[i] = np.minimum.reduceat(work, starts)
    return out.T


SIGNED = "doc_id bigint, node bigint, labels array<bigint>, signature binary"


def signed(docs: DataFrame, depth: int, trees: int = TREES) -> DataFrame:
    """``doc_id``, ``node`` (identity of the shingle set), its label in each tree and its signature.

    Texts without words (NULL too) share one node and have no labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part, texts in pieces(batches):
            sets = [shingle_set(t, known) for t in texts]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            full = [i for i, s in enumerate(sets) if len(s)]
            labels: list = [[]] * len(sets)
            signatures: list = [b""] * len(sets)
            if full:
                values = min_hashes([sets[i] for i in full], trees * depth)
                low = (values & np.uint32(255)).astype(np.uint8)
                keys = values.reshape(len(full), trees, depth).astype(np.uint64)
                label = np.zeros((len(full), trees), dtype=np.uint64)
                for d in range(depth):
                    label = (label ^ keys[:, :, d]) * np.uint64(0x9E3779B97F4A7C15)
                    label ^= label >> np.uint64(29)
                for row, i in enumerate(full):
                    labels[i] = label[row].view(np.int64)
                    signatures[i] = low[row].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(nodes),
                    pa.array(labels, pa.list_(pa.int64())), pa.array(signatures, pa.binary()),
                ],
                ["doc_id", "node", "labels", "signature"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SIGNED)


def _links(
    left: list[np.ndarray], right: list[np.ndarray], left_sig: np.ndarray, right_sig: np.ndarray, threshold: float
) -> np.ndarray:
    """Which sets of the left and the right are similar, exactly."""
    out = np.zeros((len(left), len(right)), dtype=bool)
    agree = SCREEN * left_sig.shape[1]
    maybe = np.zeros_like(out)
    for i, sig in enumerate(left_sig):
        maybe[i] = (right_sig == sig).sum(axis=1) >= agree
    rows, columns = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
    if not len(rows):
        return out
    if maybe.sum() <= 4 * (len(rows) + len(columns)):
        for i, j in zip(*np.nonzero(maybe)):
            both = len(np.intersect1d(left[i], right[j], assume_unique=True))
            out[i, j] = both >= threshold * (len(left[i]) + len(right[j]) - both)
        return out
    shared = np.intersect1d(
        np.unique(np.concatenate([left[i] for i in rows])), np.unique(np.concatenate([right[j] for j in columns]))
    )
    both = np.zeros((len(rows), len(columns)), dtype=np.float32)
    step = max(1, (1 << 25) // (len(rows) + len(columns)))
    for at in range(0, len(shared), step):
        some = shared[at : at + step]
        both += _incidence(left, rows, some) @ _incidence(right, columns, some).T
    sizes = np.array([len(left[i]) for i in rows])[:, None] + np.array([len(right[j]) for j in columns])[None, :]
    out[np.ix_(rows, columns)] = both >= threshold * (sizes - both)
    return out


def _incidence(sets: list[np.ndarray], chosen: np.ndarray, some: np.ndarray) -> np.ndarray:
    out = np.zeros((len(chosen), len(some)), dtype=np.float32)
    for row, i in enumerate(chosen):
        held = sets[i][np.searchsorted(sets[i], some[0]) : np.searchsorted(sets[i], some[-1], side="right")]
        at = np.searchsorted(some, held)
        out[row, at[some[at] == held]] = 1
    return out


VERIFIED = "node bigint, root bigint, links bigint, whole boolean"


def _verifier(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        """All links between two blocks of a candidate group (or within one)."""
        nodes = group.column("node").to_numpy()
        _, once = np.unique(nodes, return_index=True)
        group, nodes = group.take(once), nodes[once]
        block = group.column("block").to_numpy()
        first, second = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        sets = [np.frombuffer(b.as_buffer(), dtype=np.uint64) for b in group.column("shingles")]
        signatures = np.array([np.frombuffer(b.as_buffer(), dtype=np.uint8) for b in group.column("signature")])
        weights = group.column("n_docs").to_numpy()
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        links = np.zeros(len(nodes), dtype=np.int64)
        root = np.arange(len(nodes))
        if len(left) and len(right):
            found = _links([sets[i] for i in left], [sets[j] for j in right], signatures[left], signatures[right], threshold)
            if first == second:
                np.fill_diagonal(found, False)
            links[left] += found @ weights[right]
            if first != second:
                links[right] += found.T @ weights[left]
            # Nodes ascend, so the least index of a component is its least node.
            while True:
                before = root.copy()
                most = len(nodes)
                np.minimum.at(root, left, np.where(found, root[right][None, :], most).min(axis=1))
                np.minimum.at(root, right, np.where(found, root[left][:, None], most).min(axis=0))
                root = root[root]
                if (root == before).all():
                    break
        keep = links > 0
        return pa.table({
            "node": nodes[keep], "root": nodes[root[keep]], "links": links[keep],
            "whole": pa.array(np.full(int(keep.sum()), group.column("blocks")[0].as_py() == 1)),
        })

    return run


def similarity_classes(
    docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, target: float = RECALL, block: int = BLOCK
) -> DataFrame:
    """``doc_id``, ``class_id``, ``n_links`` for every row of ``docs`` (doc_id, text).

    ``n_links`` is the number of other rows with a similarity of ``threshold`` or more,
    ``class_id`` the least doc_id that is connected by links. Texts with equal shingle sets
    have similarity 1; those without words are alike and like nothing else. Texts of one to
    four words are a single shingle. Rows with a NULL doc_id get a class only with others
    that have one; rows that repeat a doc_id are counted as rows. Other columns are ignored.
    An empty table gives no rows.
    """
    depth = shortened(threshold, trees, target=target)
    rows = stage(signed(docs, depth, trees), "signed")
    sets = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_docs"))
    labels = rows.filter(F.col("doc_id").isNotNull()).select(
        "node", F.posexplode("labels").alias("tree", "label")
    )
    buckets = (
        labels.groupBy("tree", "label").agg(F.min("node").alias("least_node"), F.max("node").alias("most_node"))
        .filter(F.col("least_node") < F.col("most_node")).drop("most_node")
    )
    candidate = labels.join(buckets, ["tree", "label"]).select(F.col("node").alias("a"), F.col("least_node").alias("b"))
    groups = stage(connected(candidate.distinct()), "groups")
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / block).alias("blocks"))
    signatures = rows.groupBy("node").agg(F.first("signature").alias("signature"))
    members = (
        groups.join(sizes, "root").join(sets, "node").join(signatures, "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    )
    members = stage(members, "members")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part, texts in pieces(batches):
            found = [shingle_set(t, known) for t in texts]
            same = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in found], dtype=np.uint64).view(np.int64)
            part = part.drop_columns(["text"]).append_column("shingles", pa.array([s.tobytes() for s in found], pa.binary()))
            yield part.filter(pa.array(same == part.column("node").to_numpy()))

    texts = docs.select(F.col("doc_id").cast("bigint").alias("least"), "text")
    held = members.join(texts, "least").select("root", "node", "n_docs", "blocks", "block", "signature", "text")
    held = held.mapInArrow(
        shingled, "root bigint, node bigint, n_docs bigint, blocks bigint, block bigint, signature binary, shingles binary"
    )
    meetings = F.explode(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda other: F.struct(F.least(other, F.col("block")).alias("low"), F.greatest(other, F.col("block")).alias("high")),
    ))
    paired = held.withColumn("_m", meetings).select("*", "_m.low", "_m.high").drop("_m")
    verified = stage(paired.groupBy("root", "low", "high").applyInArrow(_verifier(threshold), VERIFIED), "verified")
    # A group of one block is settled by its task; the others are joined over their blocks.
    split = connected(verified.filter("NOT whole").select(F.col("node").alias("a"), F.col("root").alias("b")))
    whole = verified.filter("whole").select("node", "root")
    classes = whole.unionByName(split)
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    per_node = (
        sets.join(classes, "node", "left").join(links, "node", "left")
        .select("node", "least", "n_docs", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    least = per_node.groupBy("root").agg(F.min("least").alias("class_id"))
    per_node = per_node.join(least, "root").select("node", "class_id", (F.col("links") + F.col("n_docs") - 1).alias("n_links"))
    return rows.select("doc_id", "node").join(per_node, "node").select("doc_id", "class_id", "n_links")
