"""Packing of tokenized documents into sequences of a fixed window, by best-fit decreasing."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.common import fresh, slices, text_bytes

WINDOW = 2048
END_ID = 1
#: Bytes of text that are packed together: each such group has its own sequences. A group leaves one or two windows
#: partly empty, so some 700 windows in a group keep the padding far below one percent.
GROUP_BYTES = 4_000_000
#: Chunks of text whose ids a Python worker remembers before it starts anew.
REMEMBERED = 1_000_000
#: Bytes of text whose chunks are told apart together.
CHUNK_BYTES = 1 << 23

_loaded: dict[str, "Ids"] = {}


class Ids:
    """The ids of texts.

    Where a tokenizer cuts at white space first, a text's ids are those of its chunks between white space. Chunks repeat, so
    their ids are remembered. This holds for texts below U+0250, which need no normalisation beyond lower case; every
    other text, texts with a special token's string, and every tokenizer of another kind, go through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = str(self.tokenizer.normalizer).replace("\\\\", "\\"), str(self.tokenizer.pre_tokenizer)
        self.by_chunk = (
            kind[0] == r'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])'
            and kind[1].startswith("Sequence(pretokenizers=[Split(")
            and "behavior=Removed, invert=True" in kind[1]
            and r"[^\s" in kind[1]
        )
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # U+0130 has two characters in lower case
        self.odd = "|".join([r"[^\x{00}-\x{1b}\x{20}-\x{12f}\x{131}-\x{24f}]", *map(re.escape, special)])
        # chunks met so far, and where each one's ids are
        self.chunks = pa.array([], pa.string())
        self.ends = np.zeros(1, np.int64)
        self.ids = np.zeros(0, "<u4")

    def _ids_of(self, chunks: pa.StringArray) -> dict[str, bytes]:
        """Ids of those chunks that are remembered."""
        at = pc.index_in(chunks, value_set=self.chunks)
        there = chunks.filter(at.is_valid()).to_pylist()
        at = at.drop_null().to_numpy()
        return {c: self.ids[self.ends[i] : self.ends[i + 1]].tobytes() for c, i in zip(there, at, strict=True)}

    def _encoded(self, new: list[str]) -> list[bytes]:
        """Ids of new chunks."""
        # a word and the full stop or comma after it are cut apart anyway
        stems = {c: c[:-1] for c in new if c and c[-1] in ".," and c[:-1].isalpha()}
        known = self._ids_of(pa.array([".", ",", *set(stems.values())], pa.string()))
        asked = {*(c for c in new if c not in stems), *stems.values(), ".", ","}.difference(known, ("",))
        # words of letters alone are cut out of one text, each of them a word of the tokenizer's
        words = [c for c in asked if c.isalpha()]
        if words:
            found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            ends = (4 * np.searchsorted(found.word_ids, np.arange(len(words)), "right")).tolist()
            known.update((c, ids[a:b]) for c, a, b in zip(words, [0, *ends], ends, strict=False))
        rest = [c for c in asked if not c.isalpha()]
        for chunk, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[chunk] = np.array(found.ids, "<u4").tobytes()
        known[""] = b""
        return [known[stems[c]] + known[c[-1]] if c in stems else known[c] for c in new]

    def _remember(self, new: pa.StringArray) -> None:
        found = self._encoded(new.to_pylist())
        ends = np.cumsum([len(x) // 4 for x in found], dtype=np.int64)
        self.chunks = pa.concat_arrays([self.chunks, new])
        self.ends = np.concatenate([self.ends, ends + self.ends[-1]])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])

    def _by_chunk(self, texts: pa.StringArray) -> list[np.ndarray]:
        chunks = pc.utf8_split_whitespace(pc.utf8_lower(texts))
        coded = chunks.flatten().dictionary_encode()
        each = coded.dictionary
        at = pc.index_in(each, value_set=self.chunks)
        if len(self.chunks) + at.null_count > REMEMBERED:
            self.chunks, self.ends, self.ids = self.chunks.slice(0, 0), self.ends[:1], self.ids[:0]
            at = pa.nulls(len(each), pa.int32())
        place = at.fill_null(0).to_numpy().astype(np.int64)
        if at.null_count:
            place[at.is_null().to_numpy(zero_copy_only=False)] = len(self.chunks) + np.arange(at.null_count)
            self._remember(each.filter(at.is_null()))
        at = place[coded.indices.to_numpy()]
        begin, size = self.ends[at], self.ends[at + 1] - self.ends[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)]
        bounds = ends[chunks.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def of(self, texts: pa.StringArray) -> list[np.ndarray]:
        """The ids of each text."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) if self.by_chunk else np.ones(len(texts), bool)
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        for i in np.flatnonzero(odd):
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
        plain = np.flatnonzero(~odd)
        if len(plain):
            for i, ids in zip(plain, self._by_chunk(texts.take(pa.array(plain))), strict=True):
                out[i] = ids
        return out


def ids_of(path: str) -> Ids:
    """One per Python worker and tokenizer file."""
    if path not in _loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _loaded[path] = Ids(path)
    return _loaded[path]


class OpenWindows:
    """Open windows by remaining capacity: a segment tree over the capacities finds the tightest that fits."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, sequence: int, capacity: int) -> None:
        self.open[capacity].append(sequence)
        at = capacity + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """A window of the least capacity that is length or more, and that capacity."""
        count, at = self.count, length + self.size
        if not count[at]:
            while at and not (at % 2 == 0 and count[at + 1]):  # up until something lies to the right
                at >>= 1
            if not at:
                return None
            at += 1
            while at < self.size:
                at *= 2
                if not count[at]:
                    at += 1
        capacity = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return self.open[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int], int]:
    """The sequence and offset of every piece, longest first with ties in the given order, and the number of sequences."""
    sequence, offset = [0] * len(lengths), [0] * len(lengths)
    tree, opened = OpenWindows(window), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found, opened = (opened, window), opened + 1
        sequence[i], capacity = found
        offset[i] = window - capacity
        if capacity > lengths[i]:
            tree.put(sequence[i], capacity - lengths[i])
    return sequence, offset, opened


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Pieces of documents in sequences: id_col, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids and then end_id; a null or empty text is end_id alone. Overlong documents are first cut into
    full windows; what is left of each is placed by best-fit decreasing within its group. Groups are dealt by a hash of
    id, text, place and, for equal rows, the number of such rows before this one in its task: neither a long document nor
    many rows of an id nor many equal rows load one group, and a repeated task deals alike in whatever order its rows
    come. Pieces of repeated rows are placed once for each row; a null id stays null; an empty table gives no pieces. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    groups = max(1, math.ceil(total / group_bytes))
    id_type = docs.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = ids_of(tokenizer), np.array([end_id], "<u4")
        copies: dict[int, int] = {}
        for batch in batches:
            data, offsets = text_bytes(batch, "text")
            salts = []
            for salt in batch.column(2).to_pylist():
                copies[salt] = before = copies.get(salt, -1) + 1
                salts.append(salt ^ before)
            salts = pa.array(salts, pa.int64())
            for first, last, _, _ in slices(data, offsets, CHUNK_BYTES):
                texts = batch.column(1).slice(first, last - first).cast(pa.string()).fill_null("")
                rows: dict[str, list] = {"row": [], "start": [], "ids": [], "doc_tokens": []}
                for i, found in enumerate(encode.of(texts)):
                    ids = np.concatenate([found, end])
                    for at in range(0, len(ids), window):
                        part = ids[at : at + window]
                        rows["row"].append(first + i)
                        rows["start"].append(at)
                        # two bytes an id on the way where that is enough
                        rows["ids"].append(part.astype("<u2").tobytes() + b"\2" if part.max() < 65536 else part.tobytes() + b"\4")
                        rows["doc_tokens"].append(len(ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows["row"], pa.int64())),
                        pa.array(rows["start"], pa.int64()),
                        pa.array(rows["doc_tokens"], pa.int64()),
                        pa.array(rows["ids"], pa.binary()),
                        salts.take(pa.array(rows["row"], pa.int64())),
                    ],
                    ["id", "start", "doc_tokens", "ids", "salt"],
                )

    pieces = docs.withColumn("salt", F.xxhash64("id", "text")).mapInArrow(
        cut, f"id {id_type}, start long, doc_tokens long, ids binary, salt long"
    )
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("salt", "start"), F.lit(groups)))

    def place(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("id", "ascending"), ("salt", "ascending"), ("start", "ascending")])
        ids = []
        for x in rows["ids"].to_pylist():
            ids.append(x[:-1] if x[-1] == 4 else np.frombuffer(x[:-1], "<u2").astype("<u4").tobytes())
        lengths = [len(x) // 4 for x in ids]
        sequence, offset, _ = best_fit_decreasing(lengths, window)
        first = key[0].as_py() << 32
        return pa.table(
            {
                "id": rows["id"],
                "start": rows["start"],
                "length": pa.array(lengths, pa.int64()),
                "ids": pa.array(ids, pa.binary()),
                "doc_tokens": rows["doc_tokens"],
                "sequence_id": pa.array([first + s for s in sequence], pa.int64()),
                "offset": pa.array(offset, pa.int64()),
            }
        )

    out = pieces.groupBy("group").applyInArrow(
        place, f"id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
    return out.withColumnRenamed("id", id_col if id_col not in out.columns else fresh(out, id_col))
