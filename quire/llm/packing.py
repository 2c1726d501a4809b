"""Packing by minimum bin slack.

Each task tokenizes its documents, cuts off whole windows, and pools what remains of each document. A
window is then filled with the multiset of remaining lengths that comes closest to capacity: a bitset
subset-sum (bit s of an integer: length s can be reached) over the distinct lengths, with counts found by
backtracking through the stored bitsets. A pattern found is used as often as the pool allows. When a task
ends, what cannot fill a window is cut at powers of two, so only full windows or powers of two are left.
No row is shuffled: a task holds one pool of bounded size.

Defined cases: a null or empty text is its end token alone; repeated rows are packed as documents of their
own; an empty table gives no pieces. ``sequence_id`` is the task's number and a count, so it is unique and
equal in a rerun over the same files.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quire.llm.common import Memo, mapped, per_worker

WINDOW = 4096
END = 2
#: Documents pooled before packing starts, and those it leaves for later choice.
POOL, POOL_KEEP = 4096, 1024
#: Bytes in each generation of the table of distinct pieces; texts, and their length, tokenized at a time.
MEMO = 96 << 20
TEXTS, CHARS = 256, 4_000_000
CHUNK = re.compile(r"[^ \t\n\r\x0b\x0c]+")
#: Code points up to U+0220 without the control marks that count as white space in some places only, and without
#: the one capital whose lower case is two code points; general punctuation.
LATIN = re.compile("[\x00-\x1b\x20-\x84\x86-\u012f\u0131-\u0220\u2010-\u2027\u2030-\u205e]*")
#: An ideograph: no text of the range above has its bytes.
MARK = "\u4e00"
_LETTERS = "".join(re.escape(chr(c)) for c in range(0x221) if chr(c).isalpha())
_DIGITS = "0-9²³¹¼½¾"
PIECE = re.compile(f"'?[{_LETTERS}]+(?:'[{_LETTERS}]+)*|[{_DIGITS}]+|[^{_LETTERS}{_DIGITS}\\s]+")

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Little-endian ids of texts, each distinct piece of a text being encoded once.

    Normalization and splitting of this tokenizer see one code point or one run without white space at a
    time, so the ids of a text are those of its pieces one after another. Pieces end at white space; in
    texts of Latin letters they end as well between letters, digits and marks, as its pattern does, except
    at an apostrophe with letters after it, and case is folded first. Pieces are encoded by the library and
    kept in a bounded table.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.memo = Tokenizer.from_file(path), Memo(MEMO)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.mark = self.tok.encode(MARK, add_special_tokens=False).ids

    def pieces(self, text: str) -> tuple[bool, list[str]]:
        """(is it plain, its pieces): plain texts hold Latin letters and no special token."""
        if LATIN.fullmatch(text) and not any(s in text for s in self.special):
            return True, PIECE.findall(text.lower())
        return False, CHUNK.findall(text)

    def encoded(self, pieces: list[str], plain: set[str]) -> Iterator[tuple[str, bytes]]:
        """Pieces with their ids. Plain ones go through the library many at a time, with a mark between them whose
        first id no plain piece has.
        """
        some, rest = [p for p in pieces if p in plain], [p for p in pieces if p not in plain]
        for at in range(0, len(some), 512):
            part = some[at : at + 512]
            ids = np.array(self.tok.encode_batch_fast([f" {MARK} ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(ids == self.mark[0])
            raw, ends = ids.tobytes(), (4 * np.append(cut, len(ids))).tolist()
            starts = [0, *(4 * (cut + len(self.mark))).tolist()]
            yield from ((p, raw[a:b]) for p, a, b in zip(part, starts, ends, strict=True))
        for at in range(0, len(rest), 8192):
            part = rest[at : at + 8192]
            yield from ((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)))

    def many(self, texts: list[str]) -> list[bytes]:
        split = [self.pieces(t) for t in texts]
        plain = set().union(*[c for latin, c in split if latin])
        new = self.memo.missing(plain.union(*[c for latin, c in split if not latin]))
        long: dict[str, bytes] = {}
        for c, own in self.encoded(new, plain):
            if len(c) > Memo.LONG:
                long[c] = own
            else:
                self.memo.put(c, own)
        held = self.memo.new
        get = (lambda c: long[c] if c in long else held[c]) if long else held.__getitem__
        return [b"".join(map(get, c)) for _, c in split]


def fill(counts: dict[int, int], capacity: int, order: list[int] | None = None) -> dict[int, int]:
    """The multiset of lengths in ``counts`` whose sum comes closest to ``capacity`` from below.

    The largest length that fits is always used, as bins then shrink the hardest items first. ``order`` has
    the lengths in ascending order, if they are at hand.
    """
    order = sorted(counts) if order is None else order
    top = bisect_right(order, capacity) - 1
    if top < 0:
        return {}
    first = order[top]
    room, full = capacity - first, (1 << capacity - first + 1) - 1
    reach, layers = 1, []
    for k in range(bisect_right(order, room) - 1, -1, -1):
        n = order[k]
        have, part = min(counts[n] - (n == first), room // n), 1
        before = reach
        while have:
            part = min(part, have)
            reach |= reach << part * n & full
            have -= part
            part *= 2
        if reach != before:
            layers.append((n, before))
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    out = {first: 1}
    for n, before in reversed(layers):
        while not before >> total & 1:
            out[n] = out.get(n, 0) + 1
            total -= n
    return out


class Packer:
    """Pools remainders by length and yields the rows of filled windows."""

    def __init__(self, window: int, task: int):
        self.window, self.next = window, task << 40
        self.by: dict[int, list] = {}
        self.counts: dict[int, int] = {}
        self.order: list[int] = []
        self.n = self.tokens = 0

    def row(self, piece: tuple, at: int) -> tuple:
        doc, start, ids, n = piece
        return (doc, start, len(ids) // 4, n, self.next, at, ids)

    def alone(self, piece: tuple) -> tuple:
        row = self.row(piece, 0)
        self.next += 1
        return row

    def add(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        if n not in self.by:
            self.by[n], self.counts[n] = [], 0
            insort(self.order, n)
        self.by[n].append(piece)
        self.counts[n] += 1
        self.n += 1
        self.tokens += n

    def pack(self, keep: int) -> Iterator[tuple]:
        """Fills windows until ``keep`` pieces, or less than a full window, are left.

        Where no multiset meets the capacity, every length left is over the slack, and the largest piece
        is cut to close it.
        """
        while self.n > keep and self.tokens >= self.window:
            pattern = fill(self.counts, self.window, self.order)
            slack = self.window - sum(n * k for n, k in pattern.items())
            for _ in range(1 if slack else min(self.counts[n] // k for n, k in pattern.items())):
                if self.n <= keep:
                    return
                at = 0
                for n, k in pattern.items():
                    for _ in range(k):
                        yield self.row(self.take(n), at)
                        at += n
                if slack:
                    doc, start, ids, n = self.take(self.order[-1])
                    yield self.row((doc, start, ids[: 4 * slack], n), at)
                    self.add((doc, start + slack, ids[4 * slack :], n))
                self.next += 1

    def take(self, n: int) -> tuple:
        pieces = self.by[n]
        piece = pieces.pop()
        self.counts[n] -= 1
        if not pieces:
            del self.by[n], self.counts[n], self.order[bisect_left(self.order, n)]
        self.n -= 1
        self.tokens -= n
        return piece

    def cut(self) -> Iterator[tuple]:
        """What is left, one after another, in windows and then powers of two of falling size."""
        rest = [p for n in sorted(self.by, reverse=True) for p in self.by[n]]
        left = self.tokens
        at, size = 0, 0
        for doc, start, ids, n in rest:
            while ids:
                if not size:
                    size = self.window if left >= self.window else 1 << left.bit_length() - 1
                take = min(size - at, len(ids) // 4)
                yield self.row((doc, start, ids[: 4 * take], n), at)
                ids, start, at, left = ids[4 * take :], start + take, at + take, left - take
                if at == size:
                    at, size, self.next = 0, 0, self.next + 1
        self.by, self.counts, self.order, self.n, self.tokens = {}, {}, [], 0, 0


def packed_rows(docs: Iterator[tuple], ids_of: WordIds, window: int = WINDOW, task: int = 0) -> Iterator[tuple]:
    """Rows as in SCHEMA for (doc_id, text) pairs."""
    packer, end = Packer(window, task), END.to_bytes(4, "little")
    for doc, ids in _encoded(docs, ids_of):
        ids += end
        n = len(ids) // 4
        whole = n // window * window
        for start in range(0, whole, window):
            yield packer.alone((doc, start, ids[4 * start : 4 * (start + window)], n))
        if whole < n:
            packer.add((doc, whole, ids[4 * whole :], n))
        if packer.n >= POOL:
            yield from packer.pack(POOL_KEEP)
    yield from packer.pack(0)
    yield from packer.cut()


def _encoded(docs: Iterator[tuple], ids_of: WordIds) -> Iterator[tuple]:
    names, texts, size = [], [], 0
    for doc, text in docs:
        names.append(doc)
        texts.append(text or "")
        size += len(texts[-1])
        if len(texts) >= TEXTS or size >= CHARS:
            yield from zip(names, ids_of.many(texts))
            names, texts, size = [], [], 0
    yield from zip(names, ids_of.many(texts))


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", window: int = WINDOW) -> DataFrame:
    """Pieces of all documents with their ids (``ids``: little-endian unsigned 32-bit), placed in sequences."""

    def run(it):
        ids_of = per_worker(("word ids", vocabulary), lambda: WordIds(tokenizer_path(vocabulary)))
        pairs = (p for b in it for p in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()))
        rows: list[tuple] = []
        size = 0
        for row in packed_rows(pairs, ids_of, window, TaskContext.get().partitionId()):
            rows.append(row)
            size += len(row[-1])
            if size > 8_000_000 or len(rows) >= 10_000:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    return mapped(docs.select("doc_id", "text"), run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 6 + [pa.binary()]
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

