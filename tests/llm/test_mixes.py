"""Mixing, hard negatives and the conversation trie, each against a plain version of the same rules."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from tripleloom.llm import mixing, negatives, prefixes, queries, scan
from tripleloom.llm.common import written

SF = "/root/testdata/sf0.001"
BLANKS = re.compile("[^\x20\x09-\x0d]+")


# ---- running values

def test_running_sums_across_ranges(spark):
    """Segments of one row, over several ranges and over a whole range, a null one among them."""
    rows = [(None if s == 2 else s, i, i % 7) for s, n in enumerate((1, 300, 5, 0, 40)) for i in range(n)]
    df = written(spark.createDataFrame(rows, "s int, i int, v long").repartition(3), "rows")
    got = scan.running(df, "s", ["i"], scan.Sums(total="v"), 0).collect()
    sums = defaultdict(int)
    for r in sorted(got, key=lambda r: (r["s"] is not None, r["s"] or 0, r["i"])):
        sums[r["s"]] += r["v"]
        assert r["total"] == sums[r["s"]]
    assert len(got) == len(rows)


# ---- mixing

def words(text):
    return len(BLANKS.findall(text or ""))


def expected_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return {s: float(most * sizes[s]) for s in names}
        level = (sum(sizes.values()) - sum(most * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        above = {s for s in free if most * sizes[s] <= level * weight[s]}
        if not above:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= above


def check_mix(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, row int, copy int")
    got = mixing.taken(docs).collect()
    assert Counter((r["id"], r["size"]) for r in got) == Counter((r[0], words(r[1])) for r in rows)
    source = {(r[0], words(r[1])): r[2] for r in rows}
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[2]] += words(r[1])
    target = expected_targets(sizes)
    for r in got:
        of = source[(r["id"], r["size"])]
        assert r["source_size"] == sizes[of] and r["target"] == pytest.approx(target[of]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[of] += r["taken"]
    # to a word: the stream is cut in the middle of a document, at the whole budget at the latest
    assert all(abs(taken[s] - target[s]) <= 1 + len(sizes) for s in sizes)
    assert sum(taken.values()) <= sum(sizes.values())
    return got


def test_mix(spark):
    rows = [(i, "w " * (i % 40) + "x", "s" + str(i % 4), "clash", 1, 2) for i in range(400)] + [(9000, "tiny one", "zz", "", 0, 0)]
    got = check_mix(spark, rows)
    tiny = next(r for r in got if r["id"] == 9000)
    assert tiny["target"] == 6 == tiny["taken"]  # three times its size, all of it
    again = mixing.taken(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string, size string, row int, copy int").repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_mix_of_odd_rows(spark):
    long = " ".join(["long"] * 30_000)
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", None), (None, None, None), (3, long, "b"), (4, "   ", "b"), (5, "one", ""), (5, "two words", "")]
    rows += [(7, "the same row again", "hot")] * 3000
    got = check_mix(spark, [(*r, "c", 0, 1) for r in rows])
    hot = Counter(r["taken"] for r in got if r["id"] == 7)
    assert max(hot) - min(hot) <= 4  # equal rows are taken as often as each other, up to a pass
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.taken(empty).collect() == [] == mixing.schedule(empty).collect()
    nothing = mixing.taken(spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")).collect()
    assert all(r["taken"] == r["target"] == 0 for r in nothing) and len(nothing) == 2


def test_schedule_is_a_fair_stream(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = sorted(mixing.schedule(docs).where("words > 0").collect(), key=lambda r: r["position"])
    assert [r["position"] for r in mixed[1:]] == np.cumsum([r["words"] for r in mixed])[:-1].tolist()
    # at every moment each source has had its share of what has gone by, up to the document under way
    longest = defaultdict(int)
    for r in mixed:
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    total, had, target = sum(r["words"] for r in mixed), Counter(), {r["source"]: r["target"] for r in mixed}
    for r in mixed:
        had[r["source"]] += r["words"]
        gone = min(r["finish"], 1.0)
        assert all(abs(had[s] - target[s] * gone) <= longest[s] + 2 for s in had)
    assert total == pytest.approx(sum(target.values()), abs=len(target) + 1)


# ---- hard negatives

@pytest.mark.parametrize("m, k, n", [(1, 1, 1), (17, 64, 33), (40, 31, 129), (64, 0, 5), (0, 3, 4)])
def test_strassen(m, k, n):
    rng = np.random.default_rng(m + k + n)
    a, b = rng.integers(-(2**20), 2**20, (m, k)), rng.integers(-(2**20), 2**20, (k, n))
    assert (negatives.strassen(a, b) == a @ b).all()


def test_scores_beyond_64_bits():
    a = np.array([[2**40, 1], [1, -(2**57)]], np.int64)
    assert negatives.scores(a, a).tolist() == [[2**58, 2**40 - 2**57], [2**40 - 2**57, 2**58]]


def mined(rows, is_anchor, positives=5, most=10):
    known = [(i, [int(np.floor(256 * float(x))) for x in v], label) for i, v, label in rows
             if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, v, label) in enumerate(known):
        if not is_anchor(i):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=False)), j, lab) for m, (j, w, lab) in enumerate(known) if m != n]
        scored.sort()
        for down, p, _ in [s for s in scored if s[2] == label][:positives]:
            window = [s for s in scored if s[2] != label and 30 * -down <= 100 * -s[0] <= 90 * -down][:most]
            out += [(i, p, rank, j, -down, -s) for rank, (s, j, _) in enumerate(window, 1)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    """Odd rows, ties and many copies; also over many blocks and more than one merge."""
    rng = np.random.default_rng(5)
    base = rng.normal(0, 0.3, (4, 6))
    rows = [(i, [float(np.float32(x)) for x in base[i % 4] + rng.normal(0, 0.2, 6)], i % 3) for i in range(240)]
    rows += [(3, rows[3][1], 0)] * 12 + [(20, rows[20][1], rows[20][2])] * 7 + [(500 + i, rows[7][1], 2) for i in range(5)]
    rows += [(600, None, 1), (601, [0.1, None, 0.2, 0.0, 0.0, 0.0], 1), (602, [float("nan")] * 6, 1), (603, [float("inf")] * 6, 0), (604, [0.5] * 6, None)]
    rows += [(None, [0.5] * 6, 1), (620, [], 1), (621, [0.7], 2), (622, [0.25] * 9, 0), (623, [0.0] * 6, 1), (640, [-0.4] * 6, 2), (660, [1e5] * 6, 1)]
    df = spark.createDataFrame(rows, "id long, vector array<float>, label int").withColumns({c: F.lit("own") for c in ("row", "block", "side", "heap", "score", "copies")})
    expected = mined([(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows], lambda i: i % 20 == 0)
    assert len(expected) > 300
    assert sorted(map(tuple, negatives.mine(df, F.col("id") % 20 == 0).collect())) == expected
    for name, value in (("ANCHORS", 5), ("CANDIDATES", 16), ("FAN", 3), ("TILE", (4, 7))):
        monkeypatch.setattr(negatives, name, value)
    assert sorted(map(tuple, negatives.mine(df, F.col("id") % 20 == 0).collect())) == expected
    assert negatives.mine(df.where("false"), F.col("id") % 20 == 0).collect() == []
    assert negatives.mine(df, F.col("id") < 0).collect() == []


# ---- the trie of conversations

def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    return out


def expected_trie(rows):
    convs, members = rebuilt(rows), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, convs_ in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(convs_) - 1) * words(p[-1][1]) if p else 0
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in m if len(convs[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


def trie_rows(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit("own") for c in ("n", "h0", "k0", "words", "depth", "f0", "base", "head", "a")})
    trie = prefixes.trie(df)
    found = trie.nodes.join(prefixes.ends_digest(trie.ends), prefixes.KEY, "left")
    found = found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    return sorted(tuple(-1 if v is None else v for v in r) for r in found.collect()), trie


def odd_conversations():
    rng = np.random.default_rng(3)
    rows = []
    for c in [*range(45), 81, 100, 120, 121]:  # 80 isn't there
        n = int(rng.integers(1, 9))
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"say {rng.integers(0, 2)} " * int(rng.integers(1, 3))) for t in range(n)]
    rows += [(200 + i, t, "user", f"step {t}") for i in range(30) for t in range(i + 1)]  # each one turn longer than the one before
    rows += [(300, t, None if t % 3 == 0 else "a", None if t % 2 else "b c") for t in range(130)]  # a long one
    rows += [(301, None, "x", "first"), (301, 5, "x", "last"), (301, 5, "x", "last"), (302, 1, None, ""), (302, 2, "", None), (None, 1, "u", "no id")]
    rows += [(400 + i, t, "user", f"the same {t}") for i in range(60) for t in range(3)]
    return rows


def test_trie(spark):
    rows = odd_conversations()
    got, trie = trie_rows(spark, rows)
    assert got == expected_trie(rows)
    # the stored turns that a prefix refers to make up the rebuilt conversation
    convs, own = rebuilt(rows), defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    spelled = defaultdict(dict)
    for r in trie.turns.collect():
        spelled[r["conv_id"]][r["depth"]] = sorted(own[r["from_conv"]])[r["from_turn"] - 1][2:]
    assert {c: [x[d] for d in sorted(x)] for c, x in spelled.items()} == {c: v for c, v in convs.items() if v}


def test_trie_of_nothing(spark):
    assert trie_rows(spark, [])[0] == []
    alone = [(7, 1, "u", "x")]  # its first turns come from a base that isn't there
    assert trie_rows(spark, alone)[0] == expected_trie(alone)


def test_weak_hashes_are_noticed(spark, monkeypatch):
    """Equal keys of unlike turns, and equal products of unlike runs, are found out and done again."""
    rows, keys, bases, seeds = odd_conversations(), prefixes.turn_keys, prefixes.Products.__init__, []

    def weak_keys(seed):
        seeds.append(seed)
        return tuple(k % 2 for k in keys(seed)) if seed == 0 else keys(seed)

    def weak_products(self, seed):
        bases(self, seed)
        if seed == 1:
            self.turns = lambda keys: [np.zeros(len(keys[0]), np.int64)] * 4

    monkeypatch.setattr(prefixes, "turn_keys", weak_keys)
    monkeypatch.setattr(prefixes.Products, "__init__", weak_products)
    assert trie_rows(spark, rows)[0] == expected_trie(rows)
    assert seeds == [0, 1, 2]


def test_products():
    """Products compose: a run's is that of its parts, in order."""
    p, rng = prefixes.Products(0), np.random.default_rng(1)
    keys = [rng.integers(-(2**62), 2**62, 50) for _ in range(2)]
    whole = p.scan(keys, np.zeros(50, np.int64))
    tail = p.scan([k[20:] for k in keys], np.zeros(30, np.int64))
    assert all((a[20:] == b).all() for a, b in zip(whole, p.after([int(x[19]) for x in whole], tail), strict=True))
    assert all((a == b).all() for a, b in zip(tail, p.without([int(x[19]) for x in whole], [x[20:] for x in whole]), strict=True))
    assert all((a == b[:-1]).all() for a, b in zip(p.shorter([x[1:] for x in whole], [k[1:] for k in keys]), whole, strict=True))


def test_ids_of_a_node_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "_STRETCH", 3)
    rows = odd_conversations()
    assert trie_rows(spark, rows)[0] == expected_trie(rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    assert oracle.differences(queries.QUERIES[name](spark, SF), queries.SQL[name], SF) == []


@pytest.mark.parametrize("name", ["op11_mixing", "op12_hard_negatives", "op13_prefix_trie"])
def test_queries_whole(spark, name):
    found = queries.QUERIES[name](spark, SF)
    if name == "op11_mixing":
        assert found.columns == ["doc_id", "size", "source_size", "target", "taken"]
        assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    elif name == "op12_hard_negatives":
        rows = [(r["vec_id"], [float(x) for x in r["embedding"]], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
        assert sorted(map(tuple, found.collect())) == mined(rows, lambda i: i % 100 == 0)
        assert dict(found.dtypes)["rank"] == "int"
    else:
        rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert sorted(tuple(-1 if v is None else v for v in r) for r in found.collect()) == expected_trie(rows)
