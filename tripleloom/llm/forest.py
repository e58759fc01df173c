"""N-gram Jaccard join by a MinHash LSH forest.

Each text has a label in every tree: FULL_DEPTH MinHash values of its five-word shingles, in order. Sorted, the labels are
a trie, whose nodes are the prefixes that labels share. Whole labels are matched first; then prefixes get shorter, one value at a time, until
a pair at the threshold is found with the target recall. A shorter prefix is looked at only where it brings texts together that no longer one
has: a trie node with the same texts as one below it, or as one of another tree, is left out, and of the others only new pairs are verified, exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tripleloom.llm import neighbors
from tripleloom.llm.fingerprints import signatures
from tripleloom.llm.words import constants, mix

TREES = 20
FULL_DEPTH = 8
RECALL = 0.999


def recall(similarity: float, depth: int, trees: int = TREES) -> float:
    """The chance that two texts share a prefix of this length in at least one tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_length(threshold: float, trees: int = TREES, target: float = RECALL, full: int = FULL_DEPTH) -> int:
    """The longest prefix that finds pairs at the threshold with the target recall: where shortening ends."""
    depth = full
    while depth > 1 and recall(threshold, depth, trees) < target:
        depth -= 1
    return depth


def trie_nodes(data: np.ndarray, offsets: np.ndarray, shortest: int, trees: int = TREES, full: int = FULL_DEPTH) -> np.ndarray:
    """For each text its node in every tree, as a hash of the prefix: those of whole labels first, then of each shorter prefix."""
    labels = mix(signatures(data, offsets, trees * full).reshape(-1, trees, full).astype(np.uint64) + np.uint64(1))
    # a prefix's hash is the sum over its values, so all lengths come out of one pass
    sums = np.cumsum(labels * constants(full, 41), axis=2, dtype=np.uint64)
    tree = np.arange(trees, dtype=np.uint64)
    return np.concatenate([mix(sums[:, :, depth - 1] + tree + np.uint64(depth << 32)) for depth in range(full, shortest - 1, -1)], axis=1)


def join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = neighbors.THRESHOLD,
    trees: int = TREES, target: float = RECALL, firsts: bool = False,
) -> DataFrame:
    """One row for each row of docs: id_col, class_id, n_links, n_copies; see neighbors.classes() for them, for `firsts` and for all odd cases."""
    shortest = prefix_length(threshold, trees, target)
    levels = FULL_DEPTH - shortest + 1
    return neighbors.classes(docs, lambda data, offsets: trie_nodes(data, offsets, shortest, trees), id_col, text_col, threshold, firsts=firsts, levels=levels)
