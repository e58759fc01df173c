"""Suffix-array dedup: remove every byte of a string of 50 that also starts in a document with a smaller id.

A string of 50 bytes has an anchor, the least hash among its 24-byte grams. Strings can only be equal if their anchors are, so

1. documents are dealt into buckets by a hash of id and text; a bucket sends the anchors it has, once each, to parts of the hash
   space, and a part sends back those that more than one document has;
2. a bucket sends the runs of text around its shared anchors, equal ones once, to the anchors' parts;
3. a part sorts the suffixes of its runs by two-stage sorting, compares neighbours, and finds for every string of 50 the
   least id that has it; a bucket gets these ids back and cuts.

Texts are shuffled once, by bucket; all else is small. Buckets and parts are of bounded size, as their number follows the input.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.words import constants, mix

LENGTH = 50
#: Text bytes of a bucket and of a part, on average.
BUCKET_BYTES = 4_000_000
PART_BYTES = 4_000_000
#: Bytes worked on at a time within a bucket.
SLICE_BYTES = 1 << 20
#: An anchor in more buckets than this is hot: strings around it go to parts by their own hash instead of the anchor's.
HOT_BUCKETS = 2048
#: Never occurs in UTF-8.
_BREAK = 255

_LETTER = mix(np.arange(256, dtype=np.uint64) + np.uint64(99))
_BASE = constants(1, 5)[0]
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _rolled(data: np.ndarray, k: int) -> np.ndarray:
    """The polynomial hash of the k bytes from every place on; the last k - 1 are of no use."""
    grams, width, out, done = _LETTER[data], 1, None, 0
    while True:  # grams of 1, 2, 4, ... bytes, put together by the bits of k
        if k & width:
            if out is None:
                out = grams.copy()
            else:
                out[:-width] = grams[:-width] * _power(done) + out[width:]
            done += width
        if width * 2 > k:
            return out
        wider = grams.copy()
        wider[:-width] = grams[:-width] * _power(width) + grams[width:]
        grams, width = wider, width * 2


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _least_of(values: np.ndarray, w: int) -> np.ndarray:
    """The least of the w values from every place on."""
    least, width = values.copy(), 1
    while width * 2 <= w:
        least[:-width] = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = w - width
    if rest:
        least[:-rest] = np.minimum(least[:-rest], least[rest:])
    return least


class Runs:
    """Runs of strings with one anchor in some texts: anchor, first byte, number of strings, text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        k = max(1, length * 12 // 25)
        text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
        found = []
        for lo in range(0, len(data), SLICE_BYTES):
            part = data[lo : lo + SLICE_BYTES + length - 1]
            of = text[lo : lo + len(part)]
            least = _least_of(_rolled(part, k), length - k + 1)
            starts = np.flatnonzero(of[: len(of) - length + 1] == of[length - 1 :]) if len(of) >= length else np.zeros(0, np.int64)
            if not len(starts):
                continue
            anchor, own = least[starts], of[starts]
            new = np.ones(len(starts), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])
            first = np.flatnonzero(new)
            # mixed, as least values are not spread evenly
            found.append((mix(anchor[first]), starts[first] + lo, np.diff(np.append(first, len(starts))), own[first]))
        kinds = (np.uint64, np.int64, np.int64, np.int32)
        columns = [np.concatenate(x).astype(t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)] if found else [np.zeros(0, t) for t in kinds]
        self.anchor, self.start, self.n, self.text = columns
        self.data, self.length = data, length

    def keep(self, rows: np.ndarray) -> None:
        self.anchor, self.start, self.n, self.text = (x[rows] for x in (self.anchor, self.start, self.n, self.text))

    def split(self, hot: np.ndarray) -> None:
        """Hot runs as single strings, each its own anchor by its own hash."""
        times = np.where(hot, self.n, 1)
        row = np.repeat(np.arange(len(times)), times)
        shift = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        hot = hot[row]
        self.keep(row)
        self.start = self.start + shift
        self.n = np.where(hot, 1, self.n)
        self.anchor = np.where(hot, mix(self.contents() + np.uint64(1)), self.anchor)

    def contents(self) -> np.ndarray:
        """A hash of each run's whole text and its length."""
        out = np.zeros(len(self.start), np.uint64)
        if not len(out):
            return out
        order = np.argsort(self.start, kind="stable")
        start, end = self.start[order], self.start[order] + self.n[order] + self.length - 1
        at = 0
        while at < len(order):  # slices of text that hold whole runs
            lo = start[at]
            to = max(int(np.searchsorted(start, lo + SLICE_BYTES)), at + 1)
            hi = int(end[at:to].max())
            size = hi - lo
            up, down = _powers(_BASE, size), _powers(_INVERSE, size)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(_LETTER[self.data[lo:hi]] * up[:-1], out=sums[1:])
            a, b = start[at:to] - lo, end[at:to] - lo
            out[order[at:to]] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * constants(1, 47)[0])
            at = to
        return out

    def bytes_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text of some runs, one after another, and their lengths."""
        size = self.n[rows] + self.length - 1
        index = np.arange(size.sum()) + np.repeat(self.start[rows] - (np.cumsum(size) - size), size)
        return self.data[index], size


def two_stage(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of a text in order by their first `depth` bytes or more; only the wanted ones, if a mask is given.

    Suffixes smaller than their successor are sorted directly, by eight bytes at a time where they still tie. The others
    follow by one scan over the buckets of first bytes: in order, each suffix puts the one before it at the end of what that
    one's bucket has so far. A suffix that follows from its successor needs it, so the mask is widened up to the next
    one that is sorted directly.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    step = np.zeros(n, np.int8)  # sign of the next byte less this one; the end is less than any byte
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    changes = np.flatnonzero(step)
    runs = np.diff(np.concatenate([[-1], changes]))
    smaller = np.repeat(step[changes] > 0, runs)
    if wanted is None:
        wanted = np.ones(n, bool)
    ends = np.flatnonzero(wanted & ~np.append(wanted[1:], False)) + 1
    direct = np.flatnonzero(smaller)
    stop = np.append(direct + 1, n)[np.searchsorted(direct, ends - smaller[ends - 1])]
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, ends, 1)
    np.add.at(marks, np.maximum(stop, ends), -1)
    wanted = wanted | (np.cumsum(marks[:-1]) > 0)
    direct = _sorted_directly(text, np.flatnonzero(smaller & wanted), depth)
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if wanted[n - 1]:
        induced[text[n - 1]].append(np.array([n - 1]))  # by the empty suffix
    out = []
    for c in range(256):
        ahead = induced[c]
        at = 0
        while at < len(ahead):  # a run of one byte induces within its own bucket
            before = ahead[at] - 1
            before = before[before >= 0]
            before = before[(text[before] == c) & ~smaller[before] & wanted[before]]
            if len(before):
                ahead.append(before)
            at += 1
        whole = np.concatenate([*ahead, direct[bounds[c] : bounds[c + 1]]])
        if not len(whole):
            continue
        out.append(whole)
        before = whole - 1
        before = before[before >= 0]
        before = before[(text[before] > c) & ~smaller[before] & wanted[before]]
        heads = text[before]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        cuts = np.flatnonzero(heads[1:] != heads[:-1]) + 1
        for part in np.split(before, cuts) if len(before) else []:
            induced[text[part[0]]].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, zeros beyond the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(text)]
    return out


def _sorted_directly(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    words = _eights(text)
    at = lambda p: np.where(p < len(words), words[np.minimum(p, len(words) - 1)], 0)
    key = words[places]
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    new = np.ones(len(places), bool)
    new[1:] = key[1:] != key[:-1]
    for done in range(8, depth, 8):
        group = np.cumsum(new)
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(tied):
            break
        key = at(places[tied] + done)
        order = np.lexsort((key, group[tied]))
        places[tied] = places[tied][order]
        key, of = key[order], group[tied]
        new[tied[1:]] |= (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    return places


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes, `most` at most, that each suffix shares with the one before it in order."""
    padded = np.concatenate([text, np.zeros(most + 8, np.uint8)])
    words = _eights(padded)
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for i in range(0, most - 7, 8):
        alive = alive[words[order[alive] + i] == words[order[alive - 1] + i]]
        out[alive] += 8
    alive = np.arange(1, len(order))
    for _ in range(7):  # the rest of the first word that differs, or of the end
        alive = alive[out[alive] < most]
        alive = alive[padded[order[alive] + out[alive]] == padded[order[alive - 1] + out[alive]]]
        out[alive] += 1
    return out


def _join(parts: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def _texts(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = rows["id"].to_numpy()
    parts = [(c.cast(pa.binary()) if len(c) else c) for c in rows["text"].chunks]
    lengths = np.concatenate([np.diff(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]) for c in parts if len(c)] or [np.zeros(0, np.int32)])
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    data = b"".join(b"".join(x.as_py() for x in c) for c in parts)
    return ids, np.frombuffer(data, np.uint8), offsets


class Plan:
    """The steps of one run: its string length, and the number of parts."""

    def __init__(self, length: int, parts: int, hot_buckets: int):
        self.length, self.parts, self.hot_buckets = length, parts, hot_buckets

    def part_of(self, anchor: np.ndarray) -> np.ndarray:
        return ((anchor >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def _tag(anchor: np.ndarray) -> np.ndarray:
        """40 bits of an anchor that its part doesn't fix. Two anchors taken for one cost work, not truth."""
        return anchor & np.uint64((1 << 40) - 1)

    def anchors(self, key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """Step 1, of a bucket: its anchors by part, and whether several ids have them."""
        ids, data, offsets = _texts(rows)
        runs = Runs(data, offsets, self.length)
        order = np.argsort(runs.anchor, kind="stable")
        anchor, own = runs.anchor[order], ids[runs.text[order]]
        if not len(anchor):
            return pa.table({c: pa.array([], t) for c, t in (("part", pa.int64()), ("bucket", pa.int64()), ("tags", pa.binary()), ("several", pa.binary()))})
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        several = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
        anchor = anchor[first]
        part, tag = self.part_of(anchor), self._tag(anchor)
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        tags, flags = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            tags.append((tag[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (tag[a:b] >> np.uint64(32)).astype("u1").tobytes())
            flags.append(np.packbits(several[a:b]).tobytes())
        return pa.table({"part": pa.array(part[cuts[:-1]]), "bucket": pa.array([key[0].as_py()] * len(tags), pa.int64()), "tags": pa.array(tags, pa.binary()), "several": pa.array(flags, pa.binary())})

    def shared(self, key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """Step 1, of a part: for each bucket the anchors that more than one id has, and which of them are hot."""
        tags, buckets, several = [], [], []
        for tag, bucket, flags in zip(rows["tags"].to_pylist(), rows["bucket"].to_pylist(), rows["several"].to_pylist(), strict=True):
            n = len(tag) // 5
            low, high = np.frombuffer(tag, "<u4", n), np.frombuffer(tag, "u1", n, 4 * n)
            tags.append(low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)))
            buckets.append(np.full(n, bucket))
            several.append(np.unpackbits(np.frombuffer(flags, np.uint8), count=n).astype(bool))
        tag, bucket, many = np.concatenate(tags), np.concatenate(buckets), np.concatenate(several)
        order = np.argsort(tag, kind="stable")
        tag, bucket, many = tag[order], bucket[order], many[order]
        first = np.flatnonzero(np.append(True, tag[1:] != tag[:-1]))
        n = np.diff(np.append(first, len(tag)))
        kept = np.repeat((n > 1) | np.logical_or.reduceat(many, first), n)
        hot = np.repeat(n > self.hot_buckets, n)[kept]
        tag, bucket = tag[kept], bucket[kept]
        order = np.argsort(bucket, kind="stable")
        tag, bucket, hot = tag[order], bucket[order], hot[order]
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, int)
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        # the part makes the 40 bits whole again; the upper bit tells hot ones
        packed = tag | (np.uint64(1 << 40) * hot)
        return pa.table(
            {
                "bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int64()),
                "part": pa.array([key[0].as_py()] * len(spans), pa.int64()),
                "tags": pa.array([packed[a:b].astype("<u8").tobytes() for a, b in spans], pa.binary()),
            }
        )

    def _found(self, rows: pa.Table, lists: pa.Table) -> tuple[np.ndarray, Runs, np.ndarray]:
        """A bucket's runs around shared anchors, hot ones split: ids, runs, content hashes."""
        ids, data, offsets = _texts(rows)
        runs = Runs(data, offsets, self.length)
        parts = np.repeat(lists["part"].to_numpy(), [len(x) // 8 for x in lists["tags"].to_pylist()]).astype(np.uint64)
        packed = _join(lists["tags"].to_pylist(), "<u8").astype(np.uint64)
        # part and tag as one number, to look anchors up by
        known = mix(parts) ^ (packed & np.uint64((1 << 40) - 1))
        order = np.argsort(known)
        known, hot = known[order], (packed >> np.uint64(40) > 0)[order]
        asked = mix(self.part_of(runs.anchor).astype(np.uint64)) ^ self._tag(runs.anchor)
        at = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
        hit = known[at] == asked if len(known) else np.zeros(len(asked), bool)
        runs.keep(np.flatnonzero(hit))
        is_hot = hot[at[hit]] if len(known) else np.zeros(0, bool)
        if is_hot.any():
            runs.split(is_hot)
        return ids, runs, runs.contents()

    def contents(self, key: tuple[pa.Scalar, ...], rows: pa.Table, lists: pa.Table) -> pa.Table:
        """Step 2, of a bucket: the distinct runs around shared anchors by part, with the least id of each and whether there are several."""
        kinds = (("part", pa.int64()), ("bucket", pa.int64()), ("content", pa.binary()), ("least", pa.binary()), ("several", pa.binary()), ("size", pa.binary()), ("bytes", pa.binary()))
        empty = pa.table({c: pa.array([], t) for c, t in kinds})
        if not len(rows) or not len(lists):
            return empty
        ids, runs, content = self._found(rows, lists)
        if not len(content):
            return empty
        part = self.part_of(runs.anchor)
        order = np.lexsort((content, part))
        part, sorted_content = part[order], content[order]
        first = np.flatnonzero(np.append(True, (sorted_content[1:] != sorted_content[:-1]) | (part[1:] != part[:-1])))
        own = ids[runs.text[order]]
        least = np.minimum.reduceat(own, first)
        several = np.maximum.reduceat(own, first) != least
        part, content, rows_of = part[first], sorted_content[first], order[first]
        data, size = runs.bytes_of(rows_of)
        ends = np.concatenate([[0], np.cumsum(size)])
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        return pa.table(
            {
                "part": pa.array([int(part[a]) for a, _ in spans], pa.int64()),
                "bucket": pa.array([key[0].as_py()] * len(spans), pa.int64()),
                "content": pa.array([content[a:b].astype("<u8").tobytes() for a, b in spans], pa.binary()),
                "least": pa.array([least[a:b].astype("<i8").tobytes() for a, b in spans], pa.binary()),
                "several": pa.array([np.packbits(several[a:b]).tobytes() for a, b in spans], pa.binary()),
                "size": pa.array([size[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary()),
                "bytes": pa.array([pa.compress(data[ends[a] : ends[b]].tobytes(), "zstd", asbytes=True) for a, b in spans], pa.binary()),
            }
        )

    def owners(self, key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """Step 3, of a part: for each bucket its runs that some smaller id has strings of, and the least id of each string."""
        columns = {c: rows[c].to_pylist() for c in rows.column_names}
        content, least, size = (_join(columns[c], t) for c, t in (("content", "<u8"), ("least", "<i8"), ("size", "<u4")))
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(c) // 8) for x, c in zip(columns["several"], columns["content"], strict=True)]) > 0
        sizes = [int(np.frombuffer(x, "<u4").sum()) for x in columns["size"]]
        data = _join([pa.decompress(x, n, "zstd", asbytes=True) for x, n in zip(columns["bytes"], sizes, strict=True)], "u1")
        bucket = np.repeat(np.array(columns["bucket"]), [len(x) // 8 for x in columns["content"]])
        starts = np.cumsum(size, dtype=np.int64) - size
        # equal runs of several buckets are one
        order = np.argsort(content, kind="stable")
        ordered = content[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        group = np.empty(len(content), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        single = order[first]
        own = np.minimum.reduceat(least[order], first)
        owner = self._owner_of_strings(data, starts[single], size[single].astype(np.int64), own)
        # of each run, stretches of strings with one owner
        strings = size[single].astype(np.int64) - self.length + 1
        ends = np.cumsum(strings)
        head = np.zeros(len(owner), bool)
        head[ends - strings] = True
        head[1:] |= owner[1:] != owner[:-1]
        at = np.flatnonzero(head)
        run_of = np.searchsorted(ends, at, "right")
        lengths = np.diff(np.append(at, len(owner)))
        stretches = np.bincount(run_of, minlength=len(single))
        offset = np.cumsum(stretches) - stretches
        smallest = np.minimum.reduceat(owner[at], offset)
        useful = np.flatnonzero((smallest[group] < least) | several)
        useful = useful[np.argsort(bucket[useful], kind="stable")]
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(bucket[useful]) != 0)), len(useful)) if len(useful) else np.zeros(1, int)
        out = {c: [] for c in ("bucket", "content", "stretches", "owner", "strings")}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            mine = group[useful[a:b]]
            count = stretches[mine]
            index = np.arange(count.sum()) + np.repeat(offset[mine] - (np.cumsum(count) - count), count)
            out["bucket"].append(int(bucket[useful[a]]))
            out["content"].append(content[useful[a:b]].tobytes())
            out["stretches"].append(count.astype("<u4").tobytes())
            out["owner"].append(owner[at][index].astype("<i8").tobytes())
            out["strings"].append(lengths[index].astype("<u4").tobytes())
        kinds = {"bucket": pa.int64()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.binary())) for c, v in out.items()})

    def _owner_of_strings(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The least id of every string of every run, in order: neighbouring suffixes that share `length` bytes are one string."""
        strings = size - self.length + 1
        # one text of all runs, each followed by a break
        total = int((size + 1).sum())
        text = np.full(total, _BREAK, np.uint8)
        begin = np.cumsum(size + 1) - (size + 1)
        index = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
        source = np.arange(size.sum()) + np.repeat(starts - (np.cumsum(size) - size), size)
        text[index] = data[source]
        place = np.arange(strings.sum()) + np.repeat(begin - (np.cumsum(strings) - strings), strings)
        of = np.full(total, -1, np.int64)
        of[place] = np.arange(len(place))
        order = two_stage(text, self.length, of >= 0)
        order = order[of[order] >= 0]
        equal = common_prefixes(text, order, self.length) >= self.length
        first = np.flatnonzero(~equal)
        ids = np.repeat(own, strings)[of[order]]
        out = np.empty(len(place), np.int64)
        out[of[order]] = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(order))))
        return out

    def cut(self, key: tuple[pa.Scalar, ...], rows: pa.Table, lists: pa.Table, results: pa.Table) -> pa.Table:
        """The end, of a bucket: every text's removed spans and what is left."""
        ids, data, offsets = _texts(rows)
        gone = np.zeros(len(data) + 1, np.int32)
        if len(results) and len(lists):
            _, runs, content = self._found(rows, lists)
            known = _join(results["content"].to_pylist(), "<u8")
            count = _join(results["stretches"].to_pylist(), "<u4").astype(np.int64)
            owner, strings = _join(results["owner"].to_pylist(), "<i8"), _join(results["strings"].to_pylist(), "<u4").astype(np.int64)
            offset = np.cumsum(count) - count
            order = np.argsort(known, kind="stable")
            at = np.minimum(np.searchsorted(known[order], content), len(known) - 1)
            hit = np.flatnonzero(known[order][at] == content)
            row = order[at[hit]]
            times = count[row]
            index = np.arange(times.sum()) + np.repeat(offset[row] - (np.cumsum(times) - times), times)
            run = np.repeat(hit, times)
            before = np.cumsum(strings[index]) - strings[index]
            # strings before a stretch within its own run
            before -= np.repeat(before[np.cumsum(times) - times], times) if len(times) else 0
            begin = runs.start[run] + before
            smaller = owner[index] < ids[runs.text[run]]
            begin, end = begin[smaller], (begin + strings[index] + self.length - 1)[smaller]
            np.add.at(gone, begin, 1)
            np.add.at(gone, end, -1)
        removed = np.cumsum(gone[:-1]) > 0
        spans, kept = [], []
        for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
            own = removed[lo:hi]
            flips = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(flips[::2], flips[1::2], strict=True)])
            kept.append(data[lo:hi][~own].tobytes())
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.table(
            {
                "id": pa.array(ids, pa.int64()),
                "n_bytes": pa.array(np.diff(offsets), pa.int64()),
                "spans": pa.array(spans, pa.list_(span)),
                "kept": pa.array(kept, pa.binary()),
            }
        )


def _of_group(step):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return step(key, rows)

    return run


def _of_bucket(step):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, lists: pa.Table) -> pa.Table:
        return step(key, rows, lists)

    return run


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    bucket_bytes: int = BUCKET_BYTES, part_bytes: int = PART_BYTES, hot_buckets: int = HOT_BUCKETS,
) -> DataFrame:
    """One row for each row of docs: id_col (an integer), n_bytes, spans (start, end) of removed bytes, kept (the other bytes).

    A byte goes if a string of `length` bytes around it also starts in a row with a smaller id; strings are judged on
    the input. Texts are UTF-8 bytes, a null text is empty. Rows of one id are none of them smaller, and lie in many buckets
    unless their texts are equal too. Rows with a null id lose nothing and count for nobody. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets, plan = max(1, math.ceil(total / bucket_bytes)), Plan(length, max(1, math.ceil(total / part_bytes)), hot_buckets)
    rows = docs.where(F.col("id").isNotNull()).withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(buckets)))
    by_bucket = rows.groupBy("bucket")
    tags = by_bucket.applyInArrow(_of_group(plan.anchors), "part long, bucket long, tags binary, several binary")
    lists = tags.groupBy("part").applyInArrow(_of_group(plan.shared), "bucket long, part long, tags binary")
    runs = by_bucket.cogroup(lists.groupBy("bucket")).applyInArrow(
        _of_bucket(plan.contents), "part long, bucket long, content binary, least binary, several binary, size binary, bytes binary"
    )
    owners = runs.groupBy("part").applyInArrow(_of_group(plan.owners), "bucket long, content binary, stretches binary, owner binary, strings binary")
    # a bucket's lists and results side by side
    names = ("part", "tags", "content", "stretches", "owner", "strings")
    kinds = {"part": "long"}
    both = [x.select("bucket", *[F.col(c) if c in x.columns else F.lit(None).cast(kinds.get(c, "binary")).alias(c) for c in names]) for x in (lists, owners)]
    answers = both[0].unionByName(both[1])

    def cut(key: tuple[pa.Scalar, ...], rows: pa.Table, told: pa.Table) -> pa.Table:
        is_list = pc.is_valid(told["part"])
        return plan.cut(key, rows, told.filter(is_list), told.filter(pc.invert(is_list)))

    found = by_bucket.cogroup(answers.groupBy("bucket")).applyInArrow(cut, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    alone = docs.where(F.col("id").isNull()).select(
        "id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.col("text").cast("binary").alias("kept")
    )
    return found.unionByName(alone).withColumnRenamed("id", id_col)
