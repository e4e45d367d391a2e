"""Operator 8: cost-balanced packing of tokenised documents into sequences.

Each task tokenises its documents and packs them in groups of neighbours: a group is closed when its texts reach
GROUP_BYTES (one document may be longer), so no key makes a group hot, memory is bounded, nothing is shuffled, and
documents that stand next to each other (as in a mix) share sequences. In a group the sequences are opened first: as many of full capacity as the tokens fill, and the remainder as powers of two, so
that the capacities add up to the tokens and no padding is left. Documents then go, longest first, to the sequence
whose estimated cost (linear plus quadratic in the piece lengths, as attention within a piece) is lowest among those
with room; a document that doesn't fit is cut, and the cut fills that sequence.

Defined results: a null or empty text is the end token alone; a null doc_id stays null, and null or repeated ids are
packed like others; repeated rows are packed one by one; ties of length go by doc_id (nulls last), then by place; an
empty table gives no rows; further columns are ignored. Groups follow the partitions that docs has, so the same rows
in other partitions may be cut in other places.
"""

from __future__ import annotations

import heapq
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import slices

CAPACITY = 4096
#: Bytes of text after which a packing group is closed.
GROUP_BYTES = 16 << 20
END_ID = 2
#: Rows and bytes of an Arrow batch that are tokenised at once; one row may be longer.
SLICE_ROWS, SLICE_BYTES = 1 << 14, 4 << 20
#: Words' letters, and as many words of other kinds, whose ids a task remembers: this many of late, and as many from before that.
CACHED_WORDS = 1 << 18
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def id_type(vocabulary: int) -> str:
    """How ids are stored between the stages: in two bytes where the vocabulary fits, else in four."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class Remembered(dict):
    """Values of a function by its argument. Of what was asked for longest ago most is forgotten, so memory is bounded.

    There are two generations: when the young one is full it becomes the old one, and what is asked for again comes
    back into the young one. Very long arguments aren't remembered.
    """

    def __init__(self, find: Callable[[bytes | str], bytes]) -> None:
        self.find, self.old = find, {}

    def __missing__(self, key: bytes | str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.find(key)
            if len(key) > 64:
                return ids
        if len(self) >= CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        self[key] = ids
        return ids

    def forget(self) -> None:
        self.old = {}
        self.clear()


class WordIds:
    """The ids of white-space-delimited words as little-endian bytes.

    The tokenizer's pre-tokenizer never joins characters across white space, so the ids of a text are those of its
    words in turn. Only ASCII white space delimits here; every other character reaches the tokenizer. Where the
    tokenizer is known to lower-case words and to split them into letters and other marks, a plain word (Latin-1
    letters, then marks) takes a short way: its letters go to the model as they are, for all else the whole
    tokenizer is asked.
    """

    PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?:|$%&#*]*)")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = id_type(self.tokenizer.get_vocab_size())
        self.words, self.letters, self.marks = Remembered(self.word), Remembered(self.model_ids), Remembered(self.ask)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # of byte-level BPE: these bytes stand for themselves
        others = iter(range(256, 512))
        self.bytes_as = {x: x if x in printable else next(others) for x in range(256)}
        self.short_way = all(self.ask(x) == self.model_ids(y) for x, y in (("Bright", "bright"), ("\u00c9t\u00e9", "\u00e9t\u00e9"), ("stra\u00dfe", "stra\u00dfe"))) and self.ask("one,two") == self.ask("one , two")

    def stored(self, ids: list[int]) -> bytes:
        found = array("H" if self.kind == "<u2" else "I", ids)
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def ask(self, text: str) -> bytes:
        return self.stored(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def model_ids(self, letters: str) -> bytes:
        seen = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.bytes_as)
        return self.stored([t.id for t in self.model.tokenize(seen)])

    def word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.short_way:
            if text.isalpha() and text.isascii():
                return self.letters[text.lower()]
            if m := self.PLAIN.fullmatch(text):
                letters, marks = m[1].lower(), m[2]
                return self.letters[letters] + self.marks[marks] if marks else self.letters[letters]
        return self.ask(text)

    def forget(self) -> None:
        for memory in (self.words, self.letters, self.marks):
            memory.forget()

    def text(self, data: bytes | None, end_id: int) -> bytes:
        return b"".join(map(self.words.__getitem__, (data or b"").split())) + self.stored([end_id])

    def texts(self, texts: pa.Array, end_id: int) -> list[np.ndarray]:
        """The ids of every text, as text() finds them, but each distinct word is looked at once and its ids are copied to all its places."""
        split = pc.ascii_split_whitespace(texts)  # with empty words at white-space ends, which have no ids
        words = split.flatten().dictionary_encode()
        kinds = [words.dictionary]  # of what is looked up; a word is a piece of each, most of them empty
        if self.short_way:
            parts = pc.extract_regex(words.dictionary, f"^{self.PLAIN.pattern.replace('(', '(?P<letters>', 1).replace(')(', ')(?P<marks>')}$")
            kinds = [pc.if_else(parts.is_valid(), pa.scalar(None, words.dictionary.type), words.dictionary), pc.utf8_lower(pc.struct_field(parts, "letters")), pc.struct_field(parts, "marks")]
        found, pieces = [b""], []
        for values, find in zip(kinds, (self.words, self.letters, self.marks), strict=False):
            values = values.dictionary_encode()
            pieces.append(pc.fill_null(pc.add(values.indices.cast(pa.int64()), len(found)), 0).to_numpy())
            found += [find[x] for x in values.dictionary.cast(pa.binary() if find is self.words else pa.string()).to_pylist()]
        ids, end = np.frombuffer(b"".join(found), self.kind), np.frombuffer(self.stored([end_id]), self.kind)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // ids.itemsize
        codes = np.stack(pieces, axis=1)[words.indices.to_numpy()].ravel()
        each = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        at = np.repeat(((np.cumsum(sizes) - sizes)[codes] - ends[:-1]).astype(np.int32 if ends[-1] < 1 << 31 else np.int64), each)
        at += np.arange(len(at), dtype=at.dtype)
        ids = ids[at]
        counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy()
        cuts = ends[np.concatenate([[0], np.cumsum(counts)]) * len(pieces)].tolist()
        return [np.concatenate([ids[i:j], end]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


#: A worker's tokenizers by path; they outlive a task, the words they remember don't.
KNOWN: dict[str, WordIds] = {}


def capacities(total: int, capacity: int) -> list[int]:
    """Sequence sizes that add up to total: full ones, then powers of two."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def plan(lengths: list[int], capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1.0 / CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of every piece; items are taken in descending order of length."""
    pieces, seq, rests = [], 0, []
    for item, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):  # whole sequences of one document
            pieces.append((item, start, capacity, seq, 0))
            seq += 1
        if n % capacity:
            rests.append((-(n % capacity), item, n - n % capacity))
    rests.sort()
    room = capacities(-sum(r[0] for r in rests), capacity)
    size = list(room)
    heap = [(0.0, i) for i in range(len(room))]
    for negative, item, start in rests:
        left = -negative
        while left:
            cost, i = heapq.heappop(heap)
            n = min(left, room[i])
            pieces.append((item, start, n, seq + i, size[i] - room[i]))
            start, left, room[i] = start + n, left - n, room[i] - n
            if room[i]:
                heapq.heappush(heap, (cost + linear * n + quadratic * n * n, i))
    return pieces


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group_bytes: int = GROUP_BYTES, end_id: int = END_ID) -> DataFrame:
    """One row for each piece. Sequence numbers name the partition and count in it, so they are unique."""

    def packed(names: list, ids: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        """The pieces of a group, sequences numbered from first; and the next number."""
        order = sorted(range(len(ids)), key=lambda i: (names[i] is None, names[i] or 0))
        out: list[tuple] = []
        for k, start, n, seq, offset in plan([len(ids[i]) for i in order], capacity):
            i = order[k]
            out.append((names[i], start, n, zlib.crc32(ids[i][start : start + n].astype("<u4").tobytes()), len(ids[i]), first + seq, offset))
        columns = PIECES.replace(" long", "").split(", ")
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(len(columns))], columns), max(r[5] for r in out) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = KNOWN.setdefault(tokenizer_path, None) or WordIds(tokenizer_path)
        KNOWN[tokenizer_path] = words
        names, ids, size, at = [], [], 0, TaskContext.get().partitionId() << 40
        try:
            for b in slices(batches, SLICE_ROWS, SLICE_BYTES):
                bytes_ = pc.fill_null(pc.binary_length(b["text"]), 0).to_pylist()
                for name, found, n in zip(b["doc_id"].to_pylist(), words.texts(b["text"], end_id), bytes_, strict=True):
                    names.append(name)
                    ids.append(found)
                    size += n + 1
                    if size >= group_bytes:
                        pieces, at = packed(names, ids, at)
                        yield pieces
                        names, ids, size = [], [], 0
            if ids:
                yield packed(names, ids, at)[0]
        finally:
            words.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)
