"""Near-duplicate classes, repeated passages and repeated strings, against plain versions."""

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripleloom.llm import fingerprints, forest, neighbors, passages, queries, suffixes
from tripleloom.llm.components import components

SF = "/root/testdata/sf0.001"
RANDOM = random.Random(7)
VOCABULARY = ["".join(RANDOM.choice("abcdefghijklmno") for _ in range(RANDOM.randint(2, 9))) for _ in range(3000)]


def prose(n: int) -> list[str]:
    return [RANDOM.choice(VOCABULARY) for _ in range(n)]


def changed(words: list[str], every: int) -> list[str]:
    return [RANDOM.choice(VOCABULARY) if i % every == every - 1 else w for i, w in enumerate(words)]


@pytest.fixture(scope="module")
def group():
    """A group of near copies, copies of one of them, a pair just above and one just below the threshold, and others."""
    base = prose(300)
    texts = [" ".join(changed(base, 100 + i % 50)) for i in range(40)]
    texts += [texts[3].upper()] * 3 + [texts[5] + "."]
    pair = prose(900)
    texts += [" ".join(pair), " ".join(changed(pair, 47)), " ".join(changed(pair, 40)), " ".join(changed(pair, 25))]
    texts += [" ".join(prose(120)) for _ in range(20)] + ["a b c", "A, b; c!", "a b", ""]
    return dict(enumerate(texts))


@pytest.mark.parametrize("operator", [forest.join, fingerprints.near_classes])
def test_classes(spark, group, operator):
    found = operator(spark.createDataFrame(list(group.items()), "doc_id long, text string")).collect()
    classes, links = brute.classes(group)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == {d: (classes[d], links[d]) for d in group}


def test_small_blocks(spark, group):
    """Blocks of 8 find what one block finds."""
    docs = spark.createDataFrame(list(group.items()), "doc_id long, text string")
    found = neighbors.classes(docs, lambda data, offsets: forest.trie_nodes(data, offsets, 4), block=8, levels=5).collect()
    classes, links = brute.classes(group)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == {d: (classes[d], links[d]) for d in group}


def test_op4_on_the_table(spark, texts):
    found = queries.op4_jaccard_join(spark, SF).collect()
    classes, links = brute.classes(texts)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == {d: (classes[d], links[d]) for d in texts}


def test_trie_nodes_are_prefixes():
    """Texts that share a node share all nodes above it in that tree; shorter prefixes hold more texts together."""
    base = prose(200)
    texts = [" ".join(changed(base, 30 + 7 * i)) for i in range(60)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    keys = forest.trie_nodes(data, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]), 4).reshape(60, 5, forest.TREES)
    same = keys[:, None] == keys[None]
    assert (same[:, :, 1:] >= same[:, :, :-1]).all()  # whole labels first
    pairs = [int(same[:, :, d].any(axis=2).sum()) for d in range(5)]
    assert pairs == sorted(pairs) and pairs[0] < pairs[-1]


def test_levels_find_what_the_shortest_prefix_finds(spark, group):
    """Longest prefixes first changes the order of work and nothing else; of every pair only the first meeting is verified."""
    docs = spark.createDataFrame(list(group.items()), "doc_id long, text string")
    flat = neighbors.classes(docs, lambda data, offsets: forest.trie_nodes(data, offsets, 5)[:, -forest.TREES :]).collect()
    assert sorted(map(tuple, flat)) == sorted(map(tuple, forest.join(docs).collect()))


def test_prefix_gets_shorter_until_the_recall_is_reached():
    depth = forest.prefix_length(0.8)
    assert forest.recall(0.8, depth) >= forest.RECALL > forest.recall(0.8, depth + 1)
    assert forest.prefix_length(0.99) == forest.FULL_DEPTH


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(500, i) for i in range(501, 600)] + [(7, 7), (900, 901), (901, 900), (None, 3)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 201)}, **{i: 500 for i in range(500, 600)}, 900: 900, 901: 900}


def test_shared_shingles_of_many_sets():
    generator = np.random.default_rng(3)
    sets = [np.unique(generator.integers(0, 20_000, generator.integers(1, 6000)).astype(np.uint64)) for _ in range(12)]
    found = neighbors.shared(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert found[i, j] == len(np.intersect1d(a, b))


def test_op8_on_the_table(spark, texts):
    """Every word in a run of 50 that an earlier document has goes; what goes beyond lies in a passage that is mostly equal."""
    found = {r["doc_id"]: r for r in passages.deduplicate(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    covered = brute.covered_words(texts)
    gone = {d: {i for s in r["spans"] for i in range(s["first"], s["end"])} for d, r in found.items()}
    assert {d for d, c in covered.items() if c} <= {d for d, g in gone.items() if g}
    assert sum(len(covered[d] - gone[d]) for d in texts) <= 0.01 * sum(map(len, covered.values()))
    for d, r in found.items():
        assert r["n_removed"] == len(gone[d]) and r["n_words"] == len(brute.words(texts[d]))
        assert brute.words(r["kept_text"]) == [w for i, w in enumerate(brute.words(texts[d])) if i not in gone[d]]
        for s in r["spans"]:
            assert s["source"] == s["sources"][0] and max(s["sources"]) < d
            run = brute.words(texts[d])[s["first"] : s["end"]]
            known = {w for i in s["sources"] for w in brute.words(texts[i])}
            assert sum(w in known for w in run) >= 0.8 * len(run)
    assert {r["doc_id"] for r in queries.op8_substring_dedup(spark, SF).where("n_removed > 0").collect()} == {d for d, g in gone.items() if g}


def test_fuzzy_passages(spark):
    """Words replaced, left out and put in: the passage still goes, the words around it stay."""
    passage = prose(160)
    edited = [w for i, w in enumerate(passage) if i != 40]
    edited[90:90] = ["inserted", "here"]
    edited[120] = "replaced"
    own = [prose(80) for _ in range(4)]
    docs = [(10, " ".join(own[0] + passage + own[1])), (20, " ".join(own[2] + edited + own[3])), (30, " ".join(passage[:30]))]
    found = {r["doc_id"]: r for r in passages.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found[10]["spans"] == [] and found[30]["spans"] == []
    assert found[20]["kept_text"].split() == own[2] + own[3]


def test_passages_whose_parts_have_other_holders(spark):
    """Every 20 words of a passage stand in another earlier document, the whole passage in one only."""
    docs, want = [], {}
    for n in range(0, 100, 20):
        passage = prose(90)
        docs += [(n + i, " ".join(prose(30) + passage[10 * i : 10 * i + 30] + prose(30))) for i in range(7)]
        own = [prose(40) for _ in range(4)]
        docs += [(n + 10, " ".join(own[0] + passage + own[1])), (n + 15, " ".join(own[2] + passage + own[3]))]
        want[n + 15] = " ".join(own[2] + own[3])
    found = {r["doc_id"]: r for r in passages.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {d: r["kept_text"] for d, r in found.items() if r["spans"]} == want
    assert all(s["source"] == d - 5 for d in want for s in found[d]["spans"])


def test_changed_passages_whose_seeds_have_other_holders(spark):
    """A passage with changed words stands in one earlier document; each of its seeds has another first holder, none with 50 words of it."""
    docs, want = [], {}
    for n in range(0, 100, 20):
        passage = prose(120)
        docs += [(n + i, " ".join(prose(30) + passage[10 * i : 10 * i + 30] + prose(30))) for i in range(10)]
        own = [prose(40) for _ in range(4)]
        edited = [f"changed{i}" if i % 30 == 29 and i < 119 else w for i, w in enumerate(passage)]
        docs += [(n + 12, " ".join(own[0] + passage + own[1])), (n + 15, " ".join(own[2] + edited + own[3]))]
        want[n + 15] = " ".join(own[2] + own[3])
    found = {r["doc_id"]: r for r in passages.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {d: r["kept_text"] for d, r in found.items() if r["spans"]} == want
    assert all(s["source"] == d - 3 for d in want for s in found[d]["spans"])


def test_runs_of_one_text_are_one_row(spark):
    """Near copies of one text, so that the first holders of its runs take turns: a row for each document, stretches merged by place."""
    base = prose(300)
    docs = {i: " ".join(changed(base, 40 + i % 60)) for i in range(120)}
    found = {r["doc_id"]: r for r in passages.deduplicate(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    covered = brute.covered_words(docs)
    for d, r in found.items():
        gone = {i for s in r["spans"] for i in range(s["first"], s["end"])}
        assert covered[d] <= gone
        assert all(len(set(s["sources"])) == len(s["sources"]) and max(s["sources"]) < d for s in r["spans"])


def test_ids_of_any_type_and_names_of_any_kind(spark):
    passage, more = prose(70), [prose(30) for _ in range(2)]
    rows = [("b", " ".join(more[0] + passage), 1), ("a", " ".join(passage + more[1]), 2)]
    for kind in ("string", "binary", "date"):
        docs = spark.createDataFrame(rows, "doc_id string, text string, pieces int")
        values = {"string": F.col("doc_id"), "binary": F.col("doc_id").cast("binary"), "date": F.when(F.col("doc_id") == "a", F.lit("2020-01-01")).otherwise("2021-01-01").cast("date")}
        docs = docs.withColumns({"doc_id": values[kind], **{c: F.lit("own") for c in ("hash", "later", "found", "__found", "source", "stretches", "d0", "id")}})
        found = passages.deduplicate(docs).orderBy("doc_id").collect()
        assert [r["n_removed"] for r in found] == [0, 70] and [r["pieces"] for r in found] == [2, 1]
        assert found[1]["kept_text"].split() == more[0] and found[1]["spans"][0]["source"] == found[0]["doc_id"] and found[1]["d0"] == "own"


def test_chains_keep_order():
    # three fragments in order, one out of order
    fragments = [(0, 30, 100), (35, 60, 135), (62, 80, 10), (90, 120, 190)]
    assert passages.chain(fragments)[0] == [0, 1, 3]
    # a gap that costs more than a fragment gives
    assert passages.chain([(0, 30, 0), (1000, 1030, 1000)]) == [[0], [1]]


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(5, 30), st.integers(0, 60)), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_best_chain_by_trying_all(parts):
    fragments = [(b, b + n, s) for b, n, s in parts]

    def value(chain):
        total = 0.0
        for k, i in enumerate(chain):
            b, e, s = fragments[i]
            total += e - b
            if k:
                pb, pe, ps = fragments[chain[k - 1]]
                total -= passages.GAP_COST * ((b - pe) + (s - ps - (pe - pb)))
        return total

    def follows(j, i):
        return fragments[j][1] <= fragments[i][0] and fragments[j][2] + fragments[j][1] - fragments[j][0] <= fragments[i][2]

    def grow(chain):
        yield chain
        for i in range(len(fragments)):
            if follows(chain[-1], i):
                yield from grow([*chain, i])

    best = max(value(c) for i in range(len(fragments)) for c in grow([i]))
    assert value(passages.chain(fragments)[0]) == pytest.approx(best)


def test_rare_open_seeds_are_asked_alone():
    """Two open seeds in a long stretch: the one that two rows have is one question, the one that many have is paired with all others."""
    import pyarrow as pa

    n = 200
    names = ["id", "hash", "places", "seeds", "counts", "open"]

    def asked(counts):
        rows = [[7], [1], [[20 * i for i in range(n)]], [list(range(n))], [counts], [[0, 100]]]
        return [r for b in passages._open_pairs(iter([pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names)])) for r in b.to_pylist()]

    frequent = [1000] * n
    assert len(asked(frequent)) == 2 * (n - 1) - 1 and all(r["a"] is not None for r in asked(frequent))
    found = asked([*frequent[:100], 2, *frequent[101:]])
    assert [r["u"] for r in found if r["a"] is None] == [100]
    assert {r["b"] for r in found if r["a"] is not None} == set(range(1, n))


def test_pairs_of_texts_make_no_rows(spark, monkeypatch):
    """Texts with runs of one word, no two alike, all share open seeds: what is written for them grows with the texts, not with their pairs."""
    n, counts = 240, {}
    docs = [(i, " ".join([*prose(4), *["again"] * (22 + i % 20), *prose(4), *["more"] * (22 + i // 12), *prose(30)])) for i in range(n)]

    def written(df, label, of=passages.written):
        out = of(df, label)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(passages, "written", written)
    passages.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"))
    later = {label: counts[label] for label in list(counts)[list(counts).index("known") + 1 :]}
    assert counts["open-pairs"] >= n and max(later.values()) <= 20 * n, later


@given(st.data())
@settings(max_examples=150, deadline=None)
def test_texts_left_out_have_no_chain(data):
    """Chains of a text with others, looked for at once, are those of each pair by all seeds that both have."""

    def text(more):
        steps = data.draw(st.lists(st.integers(1, 30), min_size=2, max_size=14))
        seeds = data.draw(st.lists(st.integers(0, 8), min_size=len(steps), max_size=len(steps)))
        return np.cumsum(steps), np.array(seeds, np.int64), np.array(data.draw(st.lists(st.booleans(), min_size=len(steps), max_size=len(steps)))) if more else None

    place, seed, is_open = text(True)
    others = []
    for _ in range(data.draw(st.integers(1, 5))):
        others.append(text(False)[:2])
        if data.draw(st.booleans()):  # much like the asking one
            kept = np.array(data.draw(st.lists(st.booleans(), min_size=len(place), max_size=len(place))))
            others.append(((place + data.draw(st.integers(0, 9)) + np.cumsum(data.draw(st.lists(st.integers(0, 2), min_size=len(place), max_size=len(place)))))[kept], seed[kept]))
    before = data.draw(st.integers(0, len(others)))
    want = []
    for i, (there, known) in enumerate(others[:before]):
        own, other = np.nonzero(seed[:, None] == known[None, :])
        for _, found in passages.chains(np.zeros(len(own), np.int64), place[own], there[other]) if len(own) else []:
            if any(((place[own][is_open[own]] >= b) & (place[own][is_open[own]] < e)).any() for b, e, _ in found):
                want.append((i, [x for f in found for x in f]))
    found = passages.Shared([x for x, _ in others], [x for _, x in others]).chains(place, seed, is_open, before)
    assert sorted(found) == sorted(want)


@given(st.lists(st.integers(0, 45), min_size=1, max_size=6), st.integers(1, 1000))
@settings(max_examples=60, deadline=None)
def test_kept_seeds_by_trying_all_windows(lengths, kinds):
    """Of every WINDOW neighbouring runs of a text the first of the least, of a text with fewer one; equal words make equal runs."""
    from tripleloom.llm.words import ngrams

    bounds = np.concatenate([[0], np.cumsum(lengths)])
    hashes = np.random.default_rng(kinds).integers(0, kinds, bounds[-1]).astype(np.uint64)
    text, place, seed = passages.kept_seeds(hashes, bounds)
    want = []
    for i, n in enumerate(lengths):
        own = hashes[bounds[i] : bounds[i + 1]]
        runs = [int(ngrams(own[j : j + passages.SEED], np.array([0, passages.SEED]), passages.SEED)[0][0]) for j in range(n - passages.SEED + 1)]
        windows = range(max(len(runs) - passages.WINDOW + 1, min(len(runs), 1)))
        kept = {min(range(j, min(j + passages.WINDOW, len(runs))), key=lambda x: (runs[x], x)) for j in windows}
        want += [(i, j, runs[j]) for j in sorted(kept)]
    assert list(zip(text.tolist(), place.tolist(), seed.tolist(), strict=True)) == want


def test_winnowed_seeds_meet():
    """Any 20 equal words share a kept seed."""
    from tripleloom.llm.words import Words

    def seeds(text):
        data = np.frombuffer(text.encode(), np.uint8)
        w = Words(data, np.array([0, len(data)]))
        return passages.kept_seeds(w.hashes, w.bounds)

    for _ in range(30):
        run = prose(20)
        a, b = seeds(" ".join(prose(15) + run + prose(9))), seeds(" ".join(run + prose(3)))
        assert set(a[2].tolist()) & set(b[2].tolist())


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 40_000, "part_bytes": 60_000, "hot_buckets": 1}, {"bucket_bytes": 30_000, "part_bytes": 30_000}])
def test_strings_of_the_table(spark, texts, options):
    found = suffixes.deduplicate(spark.read.parquet(f"{SF}/documents.parquet"), **options).collect()
    want = brute.without_known_strings(texts)
    assert {r["doc_id"]: bytes(r["kept"]) for r in found} == want
    for r in found:
        spans = r["spans"]
        assert sum(s["end"] - s["start"] for s in spans) == r["n_bytes"] - len(r["kept"])
        assert all(a["end"] < b["start"] for a, b in zip(spans[:-1], spans[1:], strict=True))


def test_op10(spark, texts):
    import hashlib

    want = brute.without_known_strings(texts)
    for r in queries.op10_suffix_dedup(spark, SF).collect():
        kept = want[r["doc_id"]]
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest() and r["n_removed"] == r["n_bytes"] - len(kept)


def test_strings_in_awkward_texts(spark):
    """Runs of one letter, repeats within a text, rows of one id, texts shorter than a string."""
    texts = {1: "a" * 300, 2: "b" + "a" * 120 + "c", 3: "xy" * 200, 4: "yx" * 26, 5: "q" * 49, 6: "q" * 49, 7: "été" * 40, 8: "té" + "été" * 20}
    docs = spark.createDataFrame([*texts.items(), (8, texts[8])], "doc_id long, text string")
    found = [(r["doc_id"], bytes(r["kept"])) for r in suffixes.deduplicate(docs).collect()]
    want = brute.without_known_strings(texts)
    assert sorted(found) == sorted([*want.items(), (8, want[8])])


@given(st.binary(min_size=1, max_size=80), st.lists(st.booleans(), min_size=80, max_size=80))
@settings(max_examples=200, deadline=None)
def test_two_stage_sorting(data, wanted):
    text = np.frombuffer(data, np.uint8) % 4
    plain = text.tobytes()
    order = sorted(range(len(plain)), key=lambda i: plain[i:])
    assert suffixes.two_stage(text, 100).tolist() == order
    mask = np.array(wanted[: len(plain)])
    assert [i for i in suffixes.two_stage(text, 100, mask).tolist() if mask[i]] == [i for i in order if mask[i]]
