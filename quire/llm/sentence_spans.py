"""Removal of repeated runs of sentences.

From each sentence on, and back from each, the least run of ``RUN`` or more consecutive sentences that has
``MIN_WORDS`` words is hashed (128 bits, over sentences with white space collapsed), so that a passage of
short sentences is covered whole; a sentence of ``LONG`` words is a run of its own as well, since a long
passage can be one sentence. Words and blanks are those of ``[^\x20\x09-\x0D]+``; a sentence ends at a line's
end and at a blank after a full stop, exclamation or question mark.
Runs that occur more than once anywhere are found by a partial aggregation on the hash, which also gives
the first place; every sentence covered by a run that is not at its first place is removed. Places are
ordered by doc_id (null last), then by the row's key and the sentence's number.

Defined cases: a null text has no sentences; a document of one sentence has no run but that sentence, if it is
long; passages of under ``MIN_WORDS`` words are left alone, as short sentences repeat by chance; a row repeated in full is
one document given twice and both keep the same; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACES, Written, mapped, release, row_key

RUN = 2
MIN_WORDS = 16
LONG = 40
FLUSH = 50_000
END = re.compile(r"\n|(?<=[.!?])[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the sentences, without the blanks before and after them."""
    at = 0
    for end in chain((m.start() for m in END.finditer(text)), (len(text),)):
        part = text[at:end]
        if inner := part.strip(SPACES):
            start = at + len(part) - len(part.lstrip(SPACES))
            yield start, start + len(inner)
        at = end + 1


def run_hashes(texts: list[str], run: int, min_words: int, long: int = LONG) -> list[tuple[int, int, int, int]]:
    """(h1, h2, number of the first sentence, sentences) of the runs of one document's sentences."""
    from xxhash import xxh3_64_intdigest

    words = [WORD.findall(t) for t in texts]
    n = np.array([len(w) for w in words])
    h = np.array([xxh3_64_intdigest(" ".join(w)) for w in words], np.uint64)
    size = run
    out: list[tuple[int, int, int, int]] = []
    total = np.concatenate(([0], np.cumsum(n)))
    # from each start, and to each end, to the least number of sentences that has the words
    start = np.arange(max(0, len(texts) - size + 1))
    stop = np.maximum(start + size, np.searchsorted(total, total[start] + min_words))
    end = np.arange(size, len(texts) + 1)
    first = np.minimum(end - size, np.searchsorted(total, total[end] - min_words, "right") - 1)
    ahead, back = stop <= len(texts), first >= 0
    runs = np.unique(np.concatenate((start[ahead] << 32 | stop[ahead] - start[ahead], first[back] << 32 | end[back] - first[back])))
    at, width = runs >> 32, runs & 0xFFFFFFFF
    one = np.flatnonzero(n >= long)
    at, width = np.concatenate((at, one)), np.concatenate((width, np.ones(len(one), np.int64)))
    for size in np.unique(width).tolist():
        here = at[width == size]
        a, b = np.zeros(len(here), np.uint64), np.full(len(here), size, np.uint64)
        for k in range(size):
            x = h[here + k]
            a = (a ^ x) * np.uint64(0x9E3779B97F4A7C15)
            a ^= a >> np.uint64(31)
            b = (b + x) * np.uint64(0xC2B2AE3D27D4EB4F)
            b ^= b >> np.uint64(29)
        out += zip(a.view(np.int64).tolist(), b.view(np.int64).tolist(), here.tolist(), [size] * len(here))
    return out


def covered_sentences(keyed: DataFrame, run: int, min_words: int) -> DataFrame:
    """keyed: doc_id, key_a, key_b, text. (key_a, key_b, gone): numbers of the sentences to remove."""

    names, types = ["doc_id", "key_a", "key_b", "h1", "h2", "at", "n"], [pa.int64()] * 5 + [pa.int32()] * 2

    def spans(it):
        out: list[tuple] = []
        for b in it:
            for doc, ka, kb, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key_a", "key_b", "text"))):
                found = [text[i:j] for i, j in sentences(text or "")]
                if found:
                    out.extend((doc, ka, kb, *x) for x in run_hashes(found, run, min_words))
                if len(out) > FLUSH:
                    yield _batch(out, names, types)
                    out = []
        if out:
            yield _batch(out, names, types)

    rows = Written(mapped(keyed, spans, "doc_id long, key_a long, key_b long, h1 long, h2 long, at int, n int", 500), "runs")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key_a", "key_b", "at")
    twice = rows.df.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    twice = Written(twice.select("h1", "h2", "first"), "twice")
    later = rows.df.join(twice.df, ["h1", "h2"]).where(place != F.col("first")).select("key_a", "key_b", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("at"))
    gone = Written(later.groupBy("key_a", "key_b").agg(F.array_sort(F.collect_set("at")).alias("gone")), "gone")
    rows.drop()
    twice.drop()
    release(keyed.sparkSession)
    return gone.df


def remove_repeated_sentences(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_sentences, n_removed, n_spans (maximal removed runs), n_bytes, n_bytes_removed and the kept text."""
    keyed = docs.select("doc_id", "text")
    keyed = keyed.select("doc_id", *row_key(keyed), "text")
    gone = covered_sentences(keyed, run, min_words)

    def keep(it):
        for b in it:
            out: list[tuple] = []
            size = 0
            for doc, text, drop in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "gone"))):
                out.append((doc, *kept_text(text or "", drop or ())))
                size += len(text or "")
                if size > 4_000_000:
                    yield _batch(out, names, types)
                    out, size = [], 0
            if out:
                yield _batch(out, names, types)

    names = ["doc_id", "n_sentences", "n_removed", "n_spans", "n_bytes", "n_bytes_removed", "kept"]
    types = [pa.int64()] * 6 + [pa.string()]

    rows = keyed.join(gone, ["key_a", "key_b"], "left").select("doc_id", "text", "gone")
    return mapped(rows, keep, "doc_id long, n_sentences long, n_removed long, n_spans long, n_bytes long, n_bytes_removed long, kept string", 500)


def kept_text(text: str, gone: tuple | list) -> tuple:
    """A sentence goes with the blanks after it."""
    spans, drop, out, end, runs, last = list(sentences(text)), set(gone), [], 0, 0, -2
    for k, (i, _) in enumerate(spans):
        if k in drop:
            out.append(text[end:i])
            end = spans[k + 1][0] if k + 1 < len(spans) else len(text)
            runs += k != last + 1
            last = k
    out.append(text[end:])
    kept = "".join(out)
    n = len(text.encode("utf-8", "surrogatepass"))
    return len(spans), len(drop), runs, n, n - len(kept.encode("utf-8", "surrogatepass")), kept


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
