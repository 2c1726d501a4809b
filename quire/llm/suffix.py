"""Exact removal of repeated byte strings by a range-partitioned sparse suffix sort.

Sorting every suffix of a corpus would move each byte hundreds of times. Suffixes are kept only at anchors:
of every string of ``length`` bytes, the place of the least hash among its first ``REACH`` grams. Equal
strings have their anchor at the same place, so for each string only suffixes at equal anchors can decide.

1. Each task finds its documents' anchors, the range of string starts that each anchor stands for, and two
   hashes: of the bytes that every one of these strings shares from the anchor on (the lead), and of all
   bytes that they span (the context). Anchors whose lead occurs once are done.
2. Where all contexts of a lead are equal, all its strings repeat. Else one copy of each distinct context
   is fetched, and range-partitioned by its leading bytes with sampled splitters.
3. A bucket sorts its suffixes by multikey quicksort on eight-byte keys. Among those that share the lead it
   looks for equal strings start by start, and checks each run of starts against its partner's bytes.
   Splitters fall between different leads, so no run crosses a boundary; leads with over HOT contexts are
   not put in one bucket, but their strings are counted over all tasks by a 128-bit hash.
4. Repeats found for a context hold for all anchors with it; a document's covered bytes are dropped.

Defined cases: a null or empty text has nothing to remove; repeated rows repeat each other, so their
strings go; strings never cross documents; documents under ``length`` bytes stay; an empty table gives no
rows. A lead or context is taken as equal by its hash (64 and 128 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Written, mapped, release, row_key

LENGTH = 400
REACH, GRAM = 300, 16
HOT = 10_000
#: Bytes per window of a text, per comparison within a bucket, and per bucket; rows per batch given out and per batch taken in.
BLOCK = 1 << 18
PART, BUCKET = 1 << 20, 8 << 20
FLUSH, ROWS = 50_000, 500
#: Suffixes up to which the multikey quicksort sorts by all keys at once.
SMALL = 256
_U = np.uint64


def _mix(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, np.uint64, endpoint=False) | _U(1)


def rolling(x: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` bytes, built from runs of powers of two."""
    table, odd = _mix(seed, 256), _mix(seed + 100, 64)
    level, size, out, done, k = table[x], 1, None, 0, 0
    while True:
        if length & size:
            if out is None:
                out, done = level[: len(x) - size + 1], size
            else:
                n = len(x) - done - size + 1
                out = out[:n] * odd[2 * k + 1] + level[done : done + n]
                done += size
        if done == length:
            break
        level = level[: len(level) - size] * odd[2 * k] + level[size:]
        size *= 2
        k += 1
    out = out ^ (out >> _U(29))
    out *= _U(0xBF58476D1CE4E5B9)
    return out ^ (out >> _U(32))


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Least of each window of ``width``."""
    size = 1
    while size * 2 <= width:
        key = np.minimum(key[: len(key) - size], key[size:])
        size *= 2
    rest = width - size
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


def anchors(x: np.ndarray, length: int, reach: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start): each start of a ``length``-byte string belongs to one anchor."""
    starts = len(x) - length + 1
    found = []
    for at in range(0, starts, BLOCK // 2):
        n = min(BLOCK // 2, starts - at)
        h = rolling(x[at : at + n + reach + gram - 2], gram)
        key = (h & ~_U(BLOCK - 1)) | np.arange(len(h), dtype=_U)
        found.append((_least(key, reach)[:n] & _U(BLOCK - 1)).astype(np.int64) + at)
    a = np.concatenate(found)
    first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    last = np.concatenate((first[1:], [len(a)])) - 1
    return a[first], first, last


def _anchor_rows(docs: DataFrame, length: int, reach: int, gram: int) -> DataFrame:
    lead = length - reach + 1
    names = ["key_a", "key_b", "a", "lo", "hi", "lead", "c1", "c2"]
    types = [pa.int64()] * 2 + [pa.int32()] * 3 + [pa.int64()] * 3

    def run(it):
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        out: list[tuple] = []
        for b in it:
            for ka, kb, text in zip(*(b.column(c).to_pylist() for c in ("key_a", "key_b", "text"))):
                data = (text or "").encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                view = memoryview(data)
                for a, lo, hi in zip(*(x.tolist() for x in anchors(np.frombuffer(data, np.uint8), length, reach, gram))):
                    c = xxh3_128_digest(view[lo : hi + length], a - lo)
                    lead_id = xxh3_64_intdigest(view[a : a + lead]) - (1 << 63)
                    out.append((ka, kb, a, lo, hi, lead_id, int.from_bytes(c[:8], "little", signed=True), int.from_bytes(c[8:], "little", signed=True)))
                    if len(out) == FLUSH:
                        yield _batch(out, names, types)
                        out = []
        if out:
            yield _batch(out, names, types)

    return mapped(docs, run, "key_a long, key_b long, a int, lo int, hi int, lead long, c1 long, c2 long", ROWS)


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of the rows of big-endian 64-bit keys by multikey quicksort.

    A part is split by one key into less, equal and greater than a pivot; only the equal ones go on to the
    next key. Parts of up to ``SMALL`` rows are sorted by all keys that are left.
    """
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        lo, hi, k = todo.pop()
        if hi - lo < 2 or k == words.shape[1]:
            continue
        part = order[lo:hi]
        if hi - lo <= SMALL:
            order[lo:hi] = part[np.lexsort(words[part, k:].T[::-1])]
            continue
        key = words[part, k]
        pivot = np.partition(key[:: max(1, len(key) // 9)][:9], 4)[4]
        less, more = key < pivot, key > pivot
        sides = [part[less], part[~less & ~more], part[more]]
        order[lo:hi] = np.concatenate(sides)
        i, j = lo + len(sides[0]), hi - len(sides[2])
        todo += [(lo, i, k), (i, j, k + 1), (j, hi, k)]
    return order


def _repeats(data: list[bytes], back: list[int], group: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(row, first start, last start) of strings that another row of the group has at the same place.

    Hashes are kept by row and place (bytes before the anchor); the places are compared one at a time.
    """
    n, back = len(data), np.asarray(back)
    places = int(back.max()) + 1
    h, held = np.zeros((n, places), np.uint64), np.zeros((n, places), bool)
    at = 0
    while at < n:
        stop, size = at, 0
        while stop < n and (size == 0 or size + len(data[stop]) <= PART):
            size += len(data[stop])
            stop += 1
        sizes = np.fromiter(map(len, data[at:stop]), np.int64, stop - at)
        base = np.cumsum(sizes) - sizes
        found = rolling(np.frombuffer(b"".join(data[at:stop]), np.uint8), length, 7)
        starts = sizes - length + 1
        row = np.repeat(np.arange(stop - at), starts)
        start = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
        place = back[at:stop][row] - start
        h[row + at, place] = found[base[row] + start]
        held[row + at, place] = True
        at = stop
    mixed = group.astype(np.uint64) * _U(0x9E3779B97F4A7C15)
    partner = np.full((n, places), -1, np.int32)
    for p in range(places):
        rows = np.flatnonzero(held[:, p])
        key = h[rows, p] ^ mixed[rows]
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        one, two = rows[order[same]], rows[order[same + 1]]
        partner[two, p] = one
        partner[one, p] = two
    row, place = np.nonzero(partner >= 0)
    if not len(row):
        return
    other = partner[row, place]
    breaks = np.flatnonzero((row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1) | (other[1:] != other[:-1])) + 1
    for i, j in zip(np.concatenate(([0], breaks)).tolist(), np.concatenate((breaks, [len(row)])).tolist()):
        r, o, e = int(row[i]), int(other[i]), int(back[row[i]] - place[i])
        s, off = e - (j - 1 - i), int(back[other[i]] - back[row[i]])
        if data[r][s : e + length] == data[o][s + off : e + off + length]:
            yield r, s, e
        else:
            for k in range(s, e + 1):
                if data[r][k : k + length] == data[o][k + off : k + off + length]:
                    yield r, k, k


def _bucket(length: int, lead: int):
    """Of one range of leads: sorts the suffixes, then goes through them a few leads at a time."""
    width = -(-lead // 8) * 8

    def run(it):
        # a row repeated in full brings its contexts again
        rows = list({r[:2]: r for b in it for r in zip(*(b.column(c).to_pylist() for c in ("c1", "c2", "back", "data")))}.values())
        if not rows:
            return
        keys = np.frombuffer(b"".join(d[k : k + lead].ljust(width, b"\0") for _, _, k, d in rows), ">u8").reshape(len(rows), -1).astype(_U)
        order = multikey_order(keys)
        new = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
        group = np.concatenate(([0], np.cumsum(new)))
        ends = np.append(np.flatnonzero(new) + 1, len(order))
        del keys
        at = 0
        size = np.cumsum([len(rows[k][3]) for k in order])
        while at < len(order):
            most = np.searchsorted(size, (size[at - 1] if at else 0) + PART, "right")
            fits = np.searchsorted(ends, max(most, at + 1), "right") - 1
            stop = int(ends[fits]) if fits >= 0 and ends[fits] > at else int(ends[np.searchsorted(ends, at, "right")])
            if stop - at > 1:
                part = [rows[k] for k in order[at:stop]]
                out = [(part[r][0], part[r][1], s, e) for r, s, e in _repeats([p[3] for p in part], [p[2] for p in part], group[at:stop], length)]
                for k in range(0, len(out), FLUSH):
                    yield _batch(out[k : k + FLUSH], ["c1", "c2", "s", "e"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()])
            at = stop

    return run


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _hot_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """As the buckets' result, for leads with very many contexts: strings are counted over all tasks."""

    def run(it):
        for b in it:
            for c1, c2, back, data in zip(*(b.column(c).to_pylist() for c in ("c1", "c2", "back", "data"))):
                x = np.frombuffer(data, np.uint8)
                h1, h2 = rolling(x, length, 7).view(np.int64), rolling(x, length, 8).view(np.int64)
                n = len(h1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1), pa.array(h2), pa.array([c1] * n), pa.array([c2] * n), pa.array(np.arange(n, dtype=np.int32))], ["h1", "h2", "c1", "c2", "s"]
                )

    strings = Written(mapped(contexts, run, "h1 long, h2 long, c1 long, c2 long, s int", ROWS), "strings").df
    context = F.struct("c1", "c2")
    twice = strings.groupBy("h1", "h2").agg(F.min(context).alias("x"), F.max(context).alias("y")).where("x <> y").select("h1", "h2")
    return strings.join(twice, ["h1", "h2"]).select("c1", "c2", "s", F.col("s").alias("e"))


def repeated_spans(keyed: DataFrame, length: int = LENGTH, reach: int = REACH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """keyed: key_a, key_b, text. (key_a, key_b, starts): pairs of first and last start of repeated strings."""
    spark, lead = keyed.sparkSession, length - reach + 1
    rows = Written(_anchor_rows(keyed, length, reach, gram), "anchors")
    context = F.struct("c1", "c2")
    leads = rows.df.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.min(context).alias("x"), F.max(context).alias("y")).where("n > 1")
    leads = Written(leads.select("lead", (F.col("x") == F.col("y")).alias("whole")), "leads")
    found = Written(rows.df.join(leads.df, "lead"), "repeated")
    rows.drop()
    leads.drop()
    release(spark)
    mixed = found.df.where("not whole")
    one = F.min(F.struct("key_a", "key_b", "a", "lo", "hi"))
    contexts = Written(mixed.groupBy("lead", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), one.alias("x")).select("lead", "c1", "c2", "n", "x.*"), "contexts")
    per_lead = Written(contexts.df.groupBy("lead").count().where(F.col("count") > hot).select("lead"), "hot")
    wanted = contexts.df.join(per_lead.df.withColumn("hot", F.lit(True)), "lead", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    by_doc = wanted.groupBy("key_a", "key_b").agg(F.collect_list(F.struct("c1", "c2", "a", "lo", "hi", "hot")).alias("xs"))

    def cut(it):
        out, size = [], 0
        for b in it:
            for text, xs in zip(b.column("text").to_pylist(), b.column("xs").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                for x in xs:
                    part = data[x["lo"] : x["hi"] + length]
                    out.append((x["c1"], x["c2"], x["a"] - x["lo"], x["hot"], part))
                    size += len(part)
                    if size > 4 * PART:
                        yield _batch(out, names, types)
                        out, size = [], 0
        if out:
            yield _batch(out, names, types)

    names, types = ["c1", "c2", "back", "hot", "data"], [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
    cuts = Written(mapped(keyed.join(by_doc, ["key_a", "key_b"]).select("text", "xs"), cut, "c1 long, c2 long, back int, hot boolean, data binary", ROWS), "cuts")
    release(spark)
    total = contexts.df.agg(F.sum(F.col("hi") - F.col("lo") + length)).first()[0] or 0
    suffix = F.expr(f"substring(data, back + 1, {lead})")
    ranged = cuts.df.where("not hot").select("c1", "c2", "back", "data").repartitionByRange(1 + total // BUCKET, suffix)
    repeats = mapped(ranged, _bucket(length, lead), "c1 long, c2 long, s int, e int")
    if per_lead.df.limit(1).count():
        repeats = repeats.union(_hot_repeats(cuts.df.where("hot").select("c1", "c2", "back", "data"), length))
    pair = F.array("s", "e")
    per_context = Written(repeats.groupBy("c1", "c2").agg(F.collect_list(pair).alias("pairs")), "repeats")
    cuts.drop()
    several = contexts.df.where("n > 1").select("c1", "c2").distinct().withColumn("all", F.lit(True))
    known = Written(several.join(per_context.df, ["c1", "c2"], "full"), "known")
    release(spark)
    whole = found.df.where("whole").select("key_a", "key_b", "lo", "hi")
    some = mixed.join(known.df, ["c1", "c2"]).select("key_a", "key_b", "lo", "hi", "all", "pairs")
    all_ = some.where("all").select("key_a", "key_b", "lo", "hi")
    part = some.where("all is null").select("key_a", "key_b", "lo", F.explode("pairs").alias("p"))
    part = part.select("key_a", "key_b", (F.col("lo") + F.col("p")[0]).alias("lo"), (F.col("lo") + F.col("p")[1]).alias("hi"))
    spans = whole.union(all_).union(part)
    return spans.groupBy("key_a", "key_b").agg(F.collect_set(F.array("lo", "hi")).alias("starts"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed and n_spans, one row per row of ``docs``."""
    keyed = docs.select("doc_id", "text")
    keyed = keyed.select("doc_id", "text", *row_key(keyed))
    spans = Written(repeated_spans(keyed.select("key_a", "key_b", "text"), length, **how), "spans").df
    release(docs.sparkSession)

    names = ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(it):
        out: list[tuple] = []
        size = 0
        for b in it:
            for doc, text, starts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "starts"))):
                data = (text or "").encode("utf-8", "surrogatepass")
                kept, end, spans = [], 0, 0
                for lo, hi in sorted(starts or ()):
                    if lo > end or not spans:
                        kept.append(data[end:lo])
                        spans += 1
                    end = max(end, hi + length)
                kept.append(data[end:])
                rest = b"".join(kept)
                out.append((doc, rest, len(data), len(data) - len(rest), spans))
                size += len(rest)
                if size > 4 * PART:
                    yield _batch(out, names, types)
                    out, size = [], 0
        if out:
            yield _batch(out, names, types)

    rows = keyed.join(spans, ["key_a", "key_b"], "left").select("doc_id", "text", "starts")
    return mapped(rows, run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long", ROWS)
