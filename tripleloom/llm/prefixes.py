"""A trie of conversations that share their first turns, from fingerprints that compose.

A run of turns has a product (its length and polynomial hashes of its turns), and the product of two runs in a row follows from their
products. So the fingerprint of every prefix of a rebuilt conversation comes from a prefix of its base's turns and a stretch of its own,
by arithmetic; no rebuilt text is ever made, a turn of it is a reference to a stored turn. Prefixes with one fingerprint
are a node. That they are equal is verified: the members of a node must share their last turn's key and their parent, and a key must stand for one
role and text. If either fails, everything is done again with other hashes.

Each node belongs to the smallest conversation that starts with it. The nodes of one conversation are a path, and the paths hang
together as a tree; sums over subtrees are sums over that tree, by pointer jumping, and then along each path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.common import add_columns, written
from tripleloom.llm.scan import RANGE_ROWS, Sums, counted, running
from tripleloom.llm.words import mix

_P = (1 << 31) - 1
#: Hashes of a product; two by each of a turn's keys.
_HASHES = 4
#: Ids of one stretch of a node's list of ids.
_STRETCH = 50_000


def _power(base: int, exponent: np.ndarray) -> np.ndarray:
    """base ** exponent modulo _P."""
    out, square, left = np.ones(len(exponent), np.int64), base, exponent.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square % _P, out)
        square = square * square % _P
        left = left >> 1
    return out


class Products:
    """The monoid of runs of turns: length n and hashes h0 to h3; a monoid for scan.running()."""

    names = ["n", *(f"h{j}" for j in range(_HASHES))]
    columns = ["k0", "k1"]

    def __init__(self, seed: int):
        self.bases = [int(x) % (_P - 3) + 2 for x in mix(np.arange(1, _HASHES + 1, dtype=np.uint64) + np.uint64(seed * _HASHES + 9))]
        self.inverse = [pow(b, -1, _P) for b in self.bases]

    def turns(self, keys: list[np.ndarray]) -> list[np.ndarray]:
        """Each turn's own hashes."""
        k = [x.astype(np.uint64) for x in keys]
        return [(mix(k[j // 2] + np.uint64(j + 1)) % np.uint64(_P)).astype(np.int64) for j in range(_HASHES)]

    def scan(self, keys: list[np.ndarray], first: np.ndarray) -> list[np.ndarray]:
        at = np.arange(len(first))
        out = [at - first + 1]
        for t, b, i in zip(self.turns(keys), self.bases, self.inverse, strict=True):
            terms = np.concatenate([[0], np.cumsum(t * _power(i, at) % _P)])
            out.append((terms[1:] - terms[first]) % _P * _power(b, at) % _P)
        return out

    def after(self, before: list, own: list[np.ndarray]) -> list[np.ndarray]:
        """The product of `before` and then `own`."""
        hashes = [(x * _power(b, own[0]) + y) % _P for x, y, b in zip(before[1:], own[1:], self.bases, strict=True)]
        return [before[0] + own[0], *hashes]

    def without(self, before: list, whole: list[np.ndarray]) -> list[np.ndarray]:
        """What follows `before` in `whole`, which starts with it."""
        n = whole[0] - before[0]
        return [n, *[(y - x * _power(b, n)) % _P for x, y, b in zip(before[1:], whole[1:], self.bases, strict=True)]]

    def shorter(self, whole: list[np.ndarray], keys: list[np.ndarray]) -> list[np.ndarray]:
        """`whole` without its last turn."""
        return [whole[0] - 1, *[(y - t) % _P * i % _P for y, t, i in zip(whole[1:], self.turns(keys), self.inverse, strict=True)]]


def turn_keys(seed: int) -> tuple[Column, Column]:
    """Two hashes of a turn's role and text."""
    return F.xxhash64(F.lit(2 * seed), "role", "text"), F.xxhash64(F.lit(2 * seed + 1), "text", "role")


@dataclass
class Trie:
    """nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, and the key depth, f0, f1.

    ends: conv_id and the key of the node at which each conversation ends. turns: for each conversation and depth the stored turn there
    (conv_id, depth, from_conv, from_turn counted from 1), and the key of the node.
    """

    nodes: DataFrame
    ends: DataFrame
    turns: DataFrame


KEY = ["depth", "f0", "f1"]


def _members(stored: DataFrame, rows: int, products: Products, group: int, heads: Callable[[Column], Column]) -> DataFrame:
    """A row for each rebuilt conversation and depth, the root included."""
    placed = written(running(stored, "conv_id", ["turn", "k0", "k1"], products, rows).drop("turn"), "placed")
    hashes = products.names[1:]
    first = F.collect_list(F.when(F.col("n") < group, F.struct("n", "k0", "k1", "words", *hashes)))
    # heads are short, so a conversation's list has a few turns however many it has
    convs = placed.groupBy("conv_id").agg(F.max("n").alias("own"), F.array_sort(first).alias("first"))
    convs = written(convs.withColumn("h", heads(F.col("conv_id"))), "conversations")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("first").alias("head"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(bases, "base", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast(convs.schema["first"].dataType)), F.lit(1), F.col("h")))
    convs = convs.withColumns({"g": F.size("head"), "total": F.size("head") + F.greatest("own", "h") - F.col("h")})
    of_head, of_own = F.get("head", F.col("g") - 1), F.get("first", F.col("h") - 1)
    zero = F.lit(0).cast("long")
    for j in hashes:
        convs = convs.withColumns({f"g{j}": F.coalesce(of_head[j], zero), f"o{j}": F.coalesce(of_own[j], zero)})
    convs = written(convs.drop("first"), "rebuilt")
    befores = [f"{side}{j}" for side in "go" for j in hashes]
    own = placed.join(convs.select("conv_id", "h", "g", "total", *befores), "conv_id").where("n > h")
    own = own.select("conv_id", "total", F.col("conv_id").alias("from_conv"), F.col("n").alias("from_turn"), "k0", "k1", "words", "n", F.col("h").cast("long"), F.col("g").cast("long"), *hashes, *befores)
    shared = convs.select("conv_id", "total", "base", F.explode("head").alias("t"))
    shared = shared.select("conv_id", "total", F.col("base").alias("from_conv"), F.col("t.n").alias("from_turn"), "t.k0", "t.k1", "t.words", "t.n", zero.alias("h"), zero.alias("g"), *[f"t.{j}" for j in hashes], *[zero.alias(x) for x in befores])
    given = ["k0", "k1", "n", "h", "g", *hashes, *befores]

    def values(batch: pa.RecordBatch) -> list[pa.Array]:
        x = [c.to_numpy().astype(np.int64) for c in batch.columns]
        keys, n, h, g, rest = x[:2], x[2], x[3], x[4], x[5:]
        whole, head, gone = rest[:_HASHES], rest[_HASHES : 2 * _HASHES], rest[2 * _HASHES :]
        full = products.after([g, *head], products.without([h, *gone], [n, *whole]))
        parent = products.shorter(full, keys)
        packed = [p[i] * (1 << 31) + p[i + 1] for p in (full[1:], parent[1:]) for i in (0, 2)]
        return [pa.array(full[0]), *map(pa.array, packed)]

    rows_ = add_columns(own.unionByName(shared), "depth long, f0 long, f1 long, p0 long, p1 long", values, *given)
    columns = ["conv_id", "total", "from_conv", "from_turn", "k0", "k1", "words", "depth", "f0", "f1", "p0", "p1"]
    none = F.lit(None).cast("long")
    root = convs.select("conv_id", "total", *[(zero if c in ("words", "depth", "f0", "f1") else none).alias(c) for c in columns[2:]])
    return rows_.select(columns).unionByName(root)


def _verified(members: DataFrame, stored: DataFrame) -> tuple[DataFrame, bool]:
    """Nodes, and whether each has one last turn and one parent, and each key of a turn one role and text."""
    same = ["k0", "k1", "p0", "p1"]
    nodes = members.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
        *[f(c).alias(f"{c}{end}") for c in same for f, end in ((F.min, ""), (F.max, "_most"))],
    )
    nodes = written(nodes, "nodes")
    unlike = nodes.where(" or ".join(f"{c} <> {c}_most" for c in same)).isEmpty()
    keys = stored.groupBy("k0", "k1").agg(*[f(c).alias(f"{c}{end}") for c in ("role", "text") for f, end in ((F.min, ""), (F.max, "_most"))])
    return nodes.drop(*[f"{c}_most" for c in same]), unlike and keys.where("role <> role_most or text <> text_most").isEmpty()


def _totals(paths: DataFrame, root: int | None) -> DataFrame:
    """paths (conv_id, up, a, b) with a and b summed over all that hang below, by jumping twice as far each round."""
    paths = written(paths, "paths")
    while not paths.where("up is not null").isEmpty():
        below = paths.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("a").alias("more_a"), F.sum("b").alias("more_b"))
        # above the root's path there is none, so the many that have come to it needn't ask
        arrived = F.col("up").isNull() | (F.col("up") == root)
        further = paths.where("up is not null").select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        moved = paths.where(~arrived).join(further, "up", "left").select("conv_id", F.col("next").alias("up"), "a", "b")
        moved = moved.unionByName(paths.where(arrived).withColumn("up", F.lit(None).cast("long")))
        summed = moved.join(below, "conv_id", "left")
        paths = written(summed.select("conv_id", "up", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in "ab"]), "paths")
    return paths


def trie(conversations: DataFrame, group: int = 4, heads: Callable[[Column], Column] | None = None) -> Trie:
    """The trie of all rebuilt conversations of a table conv_id, turn, role, text; see Trie.

    A conversation's turns are ordered by turn, null first; turns of one number by a hash of role and text, so equal rows all count and their order doesn't
    matter. Null role or text is empty. Conversation c is rebuilt from the first h turns of conversation c - c % 20 (the remainder has c's sign) and its own
    after its first h; h is heads(c), less than `group`, by default crc32 of c in decimal, modulo 4. A base that isn't there
    gives no turns. Rows with a null conv_id take no part. Further columns play no part. No rows, no nodes.
    """
    heads = heads or (lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(group)).cast("int"))
    empty = F.lit("")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    rows, seed, good = turns.count(), 0, False
    while not good:
        keyed = turns.withColumns(dict(zip(("k0", "k1"), turn_keys(seed), strict=True)))
        stored = written(counted(keyed.drop("role"), "text", "words"), "turns")
        members = written(_members(stored, rows, Products(seed), group, heads), "members")
        nodes, good = _verified(members, keyed)
        seed += 1
    root = nodes.where("depth = 0").select("conv_id").first()
    root = root and root[0]
    # each node's parent, by the smallest conversation of it
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f0").alias("p0"), F.col("f1").alias("p1"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").join(above.where("depth > 1"), ["depth", "p0", "p1"])
    high = nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root).cast("long")))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p0").alias("f0"), F.col("p1").alias("f1")).agg(F.count("*").alias("n_children"))
    known = deep.unionByName(high).join(children, KEY, "left").select(*KEY, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "words")
    known = known.withColumns({"leaf": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    known = written(known.drop("words"), "known")
    top = (F.col("depth") == 0) | (F.col("parent_conv_id") != F.col("conv_id"))
    tops = written(known.where(top).select("conv_id", F.col("parent_conv_id").alias("up"), (F.col("depth") - 1).alias("at")), "tops")
    own = known.groupBy("conv_id").agg(F.sum("leaf").alias("a"), F.sum("saved").alias("b"))
    totals = _totals(tops.select("conv_id", "up").join(own, "conv_id"), root)
    hanging = tops.where("up is not null").join(totals.drop("up"), "conv_id").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    summed = known.join(hanging, ["conv_id", "depth"], "left")
    summed = summed.withColumns({"leaf": F.col("leaf") + F.coalesce("a", F.lit(0)), "saved": F.col("saved") + F.coalesce("b", F.lit(0)), "up_the_path": -F.col("depth")}).drop("a", "b")
    final = running(written(summed, "summed"), "conv_id", ["up_the_path"], Sums(n_leaves="leaf", saved_tokens="saved"), rows)
    return Trie(
        final.select("conv_id", *KEY, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"),
        members.where("depth = total").select("conv_id", *KEY),
        members.where("depth > 0").select("conv_id", *KEY, "from_conv", "from_turn"),
    )


def ends_digest(ends: DataFrame) -> DataFrame:
    """For each node at which conversations end: SHA-256 of their ids in decimal, ascending, joined by commas.

    Ids are joined in sorted ranges first, so a node with very many is a few long strings, and its hash takes them in one by one.
    """
    rows = ends.count()
    ranges = max(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_ROWS + 1)

    def changes(batch: pa.RecordBatch) -> list[int]:
        columns = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in KEY]
        new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        return [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = changes(batch)
            cuts = [x for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in range(a, b, _STRETCH)] + [batch.num_rows]
            ids = batch.column(batch.schema.get_field_index("conv_id"))
            text = ids.cast(pa.string()).to_pylist()
            at = pa.array(cuts[:-1], pa.int64())
            joined = pa.array([",".join(text[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)).take(at) for c in KEY], ids.take(at), joined], [*KEY, "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                own = tuple(row[c] for c in KEY)
                if own != key:
                    if state:
                        found.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(row["ids"].encode())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], [*KEY, "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], [*KEY, "ends_sha256"])

    fields = "depth long, f0 long, f1 long"
    pieces = ends.repartitionByRange(ranges, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(stretches, f"{fields}, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, f"{fields}, ends_sha256 string")
