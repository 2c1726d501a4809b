"""Near-duplicate lines by a segment-partition edit join.

Two lines are linked if their edit distance is at most t, where t is one edit per ``PER_EDIT`` characters of
the shorter line and ``MOST_EDITS`` at most. A line of length l is split into t + 1 segments; a line within
t edits holds one of them unchanged, at a place that the two lengths bound. Lines are indexed under their
segments and probe the segments of every length they can reach, both by a hash of (length, segment number,
text). Keys carry a character sketch that drops pairs before texts are fetched; survivors are verified by a
banded bit-parallel edit distance. A key of over TILE lines is dealt as pairs of tiles. Linked lines form classes, in which only the first line stays.

Places are ordered by doc_id (null last), then by the row's key and the line's number. Lines of under
``LEAST`` characters, without their outer blanks, are left alone.

Defined cases: a null text has no lines; rows repeated in full are one document given twice and keep the
same; exact copies of a line are one node; an empty table gives no rows. Lines are equal if their 64-bit
hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACES, Written, mapped, packed, release, row_key, small, whole_groups
from quire.llm.components import components

LEAST = 20
PER_EDIT, MOST_EDITS = 40, 2
#: Distinct lines whose texts are needed, up to which their ids are broadcast (8 bytes each).
WANTED = 1_000_000
SEEN = 500_000
#: Lines of one key up to which they are compared in one task, and the share of lines that shows such keys.
TILE, SHARE = 50_000, 16
#: Rows per batch given out and per batch taken in, and characters whose keys are made at a time.
FLUSH, ROWS, CHARS = 50_000, 500, 1 << 17
_U = np.uint64
#: An odd base of the polynomial hash and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def edits(length: int) -> int:
    return min(MOST_EDITS, length // PER_EDIT)


def segments(length: int, t: int) -> list[tuple[int, int]]:
    """(start, length) of t + 1 segments; the longer ones come last."""
    short, longer = divmod(length, t + 1)
    out, at = [], 0
    for k in range(t + 1):
        n = short + (k >= t + 1 - longer)
        out.append((at, n))
        at += n
    return out


def probes(length: int) -> list[tuple[int, int, int, int]]:
    """(seed, start, end, role) of the substrings of a line of this length; role 1 indexes, 2 probes, 3 both.

    A segment i of a line of length l can start in the longer line at most i - 1 places off its own start,
    and, counted from the end, at most t + 1 - i off, or an earlier or later segment would match as well.
    """
    found: dict[tuple[int, int, int], int] = {}
    if t := edits(length):
        for i, (at, n) in enumerate(segments(length, t)):
            found[length * 4 + i, at, at + n] = 1
    for l in range(max(1, length - MOST_EDITS), length + 1):
        t, more = edits(l), length - l
        if more > t or not t:
            continue
        for i, (at, n) in enumerate(segments(l, t)):
            low = max(0, at - i, at + more - (t - i))
            high = min(length - n, at + i, at + more + (t - i))
            for s in range(low, high + 1):
                found[l * 4 + i, s, s + n] = found.get((l * 4 + i, s, s + n), 0) | 2
    return [(*k, role) for k, role in found.items()]


_PLANS: dict[int, np.ndarray] = {}


def _plan(length: int) -> np.ndarray:
    if (known := _PLANS.get(length)) is None:
        if len(_PLANS) > 20_000:
            _PLANS.clear()
        known = _PLANS[length] = np.array(probes(length), np.int64).reshape(-1, 4).T
    return known


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lines one after another, and the lines' lengths."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4"), sizes


def sketches(lines: list[str]) -> np.ndarray:
    """Sixteen counts of characters by code point, modulo 16, of each line."""
    code, sizes = _codes(lines)
    place = np.repeat(np.arange(len(lines)) * 16, sizes) + code % 16
    n = np.bincount(place, minlength=16 * len(lines)).reshape(-1, 16) & 15
    return (n.astype(_U) << np.arange(0, 64, 4, dtype=_U)).sum(axis=1, dtype=_U)


def segment_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, role, number of the line) for all probes of the lines.

    A key mixes the seed with a polynomial hash of the substring, taken from the running sums of all lines;
    equal keys of different substrings only make candidates more.
    """
    code, sizes = _codes(lines)
    up = np.cumprod(np.full(len(code) + 1, _BASE, _U))
    down = np.cumprod(np.full(len(code) + 1, _INVERSE, _U))
    total = np.concatenate((np.zeros(1, _U), np.cumsum(_mixed(code.astype(_U) + _U(1)) * up[:-1], dtype=_U)))
    plans = [_plan(n) for n in sizes.tolist()]
    count = np.fromiter((x.shape[1] for x in plans), np.int64, len(plans))
    seed, i, j, role = np.concatenate(plans, axis=1) if plans else np.zeros((4, 0), np.int64)
    line = np.repeat(np.arange(len(lines)), count)
    base = (np.cumsum(sizes) - sizes)[line]
    found = (total[base + j] - total[base + i]) * down[base + i]
    return _mixed(found ^ _mixed(seed.astype(_U))).view(np.int64), role.astype(np.int8), line


def sketch_gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of twice the edit distance: circular differences of the counts, summed."""
    out = np.zeros(len(a), np.int32)
    for k in range(0, 64, 4):
        d = ((a >> np.uint64(k)) - (b >> np.uint64(k)) & np.uint64(15)).astype(np.int32)
        out += np.minimum(d, 16 - d)
    return out


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def within(a: str, b: str, t: int) -> bool:
    """Is the edit distance at most t? Bit k of row d: all but d of what was read match ``a`` up to k - t places off.

    Each row has the 2t + 1 bits around the diagonal, so a step costs the same at any place of a long line.
    """
    if abs(len(a) - len(b)) > t:
        return False
    at = _shared(a, b)
    a, b = a[at:], b[at:]
    at = _shared(a[::-1], b[::-1])
    a, b = a[: len(a) - at], b[: len(b) - at]
    if not a or not b:
        return max(len(a), len(b)) <= t
    width = 2 * t + 1
    full = (1 << width) - 1
    # a row is shifted by one at each step: an insertion keeps its place in a, so it moves down
    rows = [full >> t - d & -(1 << t) for d in range(t + 1)]
    padded = "\0" * t + a + "\0" * t
    low_edge, high_edge = t, len(a) + t
    for i, c in enumerate(b, 1):
        match = 0
        # bit k stands for the place i - t + k in a, whose last character is padded[i - 1 + k]
        at = padded.find(c, max(i - 1, low_edge), min(i - 1 + width, high_edge))
        while at >= 0:
            match |= 1 << at - i + 1
            at = padded.find(c, at + 1, min(i - 1 + width, high_edge))
        before = fresh = 0
        # places below 0 or past the end of a do not exist
        exists = full & -(1 << max(0, t - i))
        for d in range(t + 1):
            old = rows[d]
            new = old & match
            if d:
                new |= before | before_down | fresh << 1
            if i <= d and i <= t:
                new |= 1 << t - i  # all of b so far inserted
            new &= exists
            rows[d], before, before_down, fresh = new, old, old >> 1, new
        if not rows[t]:
            return False
    k = len(a) - len(b) + t
    return bool(rows[t] >> k & 1)


def lines_of(text: str | None) -> Iterator[tuple[int, str]]:
    """(number, line without outer blanks) of the lines that take part."""
    for k, line in enumerate((text or "").split("\n")):
        line = line.strip(SPACES)
        if len(line) >= LEAST:
            yield k, line


def line_hash(line: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _occurrences(keyed: DataFrame) -> DataFrame:
    """Places of all lines; one line in SHARE, by its hash, has its segment keys beside it."""

    def run(it):
        for b in it:
            out: list[tuple] = []
            for doc, ka, kb, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key_a", "key_b", "text"))):
                for k, s in lines_of(text):
                    h = line_hash(s)
                    out.append((h, doc, ka, kb, k, None if h % SHARE else segment_keys([s])[0].tolist()))
                    if len(out) == FLUSH:
                        yield _batch(out, names, types)
                        out = []
            if out:
                yield _batch(out, names, types)

    names = ["line_id", "doc_id", "key_a", "key_b", "at", "keys"]
    types = [pa.int64()] * 4 + [pa.int32(), pa.list_(pa.int64())]
    return mapped(keyed, run, "line_id long, doc_id long, key_a long, key_b long, at int, keys array<long>", ROWS)


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _keys(texts: DataFrame) -> DataFrame:
    """Segment keys of the lines, one task giving a line it has just seen only once."""

    def run(it):
        seen: set[int] = set()
        lines, ids, size = [], [], 0
        for b in it:
            for text in b.column("text").to_pylist():
                for _, s in lines_of(text):
                    if len(s) < PER_EDIT or (h := line_hash(s)) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(h)
                    lines.append(s)
                    ids.append(h)
                    size += len(s)
                    if size > CHARS:
                        yield _columns(lines, ids)
                        lines, ids, size = [], [], 0
        if lines:
            yield _columns(lines, ids)

    def _columns(lines, ids):
        key, role, line = segment_keys(lines)
        bag = sketches(lines).view(np.int64)
        cols = [key, np.array(ids, np.int64)[line], role, bag[line]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "line_id", "role", "bag"])

    return mapped(texts, run, "key long, line_id long, role byte, bag long", ROWS)


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Does one index what the other probes? Above these two bits is the side: of a pair of tiles, sides differ."""
    roles = (a & b >> 1 | b & a >> 1) & 1
    return (roles != 0) & ((a >> 2 == 0) | (a >> 2 != b >> 2))


def _pairs(group: np.ndarray, role: np.ndarray, bag: np.ndarray, block: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) within the groups, which are numbered from 0 in order, whose roles meet and whose sketches are near."""
    n = len(group)
    end = np.searchsorted(group, group, "right")
    total = np.concatenate(([0], np.cumsum(end - np.arange(n) - 1)))
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(total, total[start] + block, "right")) - 1)
        width = np.diff(total[start : stop + 1])
        i = np.repeat(np.arange(start, stop), width)
        j = i + 1 + np.arange(len(i)) - np.repeat(total[start:stop] - total[start], width)
        start = stop
        ok = _meet(role[i], role[j])
        i, j = i[ok], j[ok]
        ok = sketch_gap(bag[i], bag[j]) <= 2 * MOST_EDITS
        yield i[ok], j[ok]


def _meeting(it):
    """Rows (key, line_id, role) that have a possible partner under their key."""
    for key, line, role, bag in whole_groups(it, "key", ("line_id", "role", "bag")):
        more = np.zeros(len(key), bool)
        same = key[1:] == key[:-1]
        more[1:] |= same
        more[:-1] |= same
        key, line, role, bag = key[more], line[more], role[more].astype(np.int64), bag[more].view(_U)
        if not len(key):
            continue
        order = np.lexsort((line, key))
        key, line, role, bag = key[order], line[order], role[order], bag[order]
        at = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (line[1:] != line[:-1]))))
        role = np.bitwise_or.reduceat(role, at)  # one line can hold a text at its own and at a probed place
        key, line, bag = key[at], line[at], bag[at]
        keep = np.zeros(len(key), bool)
        for i, j in _pairs(np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))), role, bag):
            keep[i] = keep[j] = True
        at = np.flatnonzero(keep)
        for k in range(0, len(at), FLUSH):
            p = at[k : k + FLUSH]
            yield pa.RecordBatch.from_arrays([pa.array(key[p]), pa.array(line[p]), pa.array(role[p].astype(np.int8))], ["key", "line_id", "role"])


def _verified(it):
    """Links as they are found; lines that are tied already in this group are not compared again."""
    for key, line_id, role, line in whole_groups(it, "key", ("line_id", "role", "line"), 20_000):
        order = np.lexsort((line_id, key))
        key, line_id, role, line = key[order], line_id[order].tolist(), role[order].astype(np.int64), line[order].tolist()
        root = list(range(len(key)))

        def top(x, root=root):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for ii, jj in _pairs(np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))), role, sketches(line)):
            for i, j in zip(ii.tolist(), jj.tolist()):
                if (p := top(i)) != (q := top(j)) and within(line[i], line[j], edits(min(len(line[i]), len(line[j])))):
                    root[max(p, q)] = min(p, q)
                    out.append((line_id[i], line_id[j]))
        if out:
            yield _batch(out, ["a", "b"], [pa.int64()] * 2)


def _texts(docs_text: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line_id, line) of the wanted lines; their ids are broadcast if counted to be few."""

    def run(it):
        for b in it:
            out: dict[int, str] = {}
            size = 0
            for text in b.column("text").to_pylist():
                out.update((line_hash(s), s) for _, s in lines_of(text))
                size += len(text or "")
                if out and size > 4_000_000:
                    yield _batch(list(out.items()), ["line_id", "line"], [pa.int64(), pa.string()])
                    out, size = {}, 0
            if out:
                yield _batch(list(out.items()), ["line_id", "line"], [pa.int64(), pa.string()])

    lines = mapped(docs_text, run, "line_id long, line string", ROWS)
    return lines.join(small(wanted, WANTED), "line_id", "left_semi").groupBy("line_id").agg(F.min("line").alias("line"))


def _tiled(docs_text: DataFrame, places: DataFrame, tile: int) -> DataFrame:
    """The segment keys; one that very many lines share is dealt as pairs of tiles of its lines.

    Such keys show in the sampled lines, at half the number. The sample only sets how rows are dealt: each
    pair of lines still meets in one group.
    """
    keys = _keys(docs_text)
    some = places.where("keys is not null").select(F.explode("keys").alias("key"))
    hot = Written(some.groupBy("key").agg((F.count(F.lit(1)) * SHARE).alias("n")).where(F.col("n") > tile / 2), "hot-keys")
    if not hot.df.limit(1).count():
        return keys
    tiles = F.ceil(F.coalesce("n", F.lit(1)) / tile).cast("int")
    rows = keys.join(small(hot.df), "key", "left").withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("line_id"), "tiles").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j")))
    rows = rows.select("key", "line_id", "role", "bag", "tiles", "own", F.explode(pairs).alias("p"))
    side = F.when(F.col("p.i") == F.col("p.j"), 0).when(F.col("own") == F.col("p.i"), 4).otherwise(8)
    key = F.when(F.col("tiles") == 1, F.col("key")).otherwise(F.xxhash64("key", "p.i", "p.j"))
    return rows.select(key.alias("key"), "line_id", F.col("role").bitwiseOR(side.cast("byte")).alias("role"), "bag")


def _by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key")


def line_links(docs_text: DataFrame, places: DataFrame, tile: int = TILE) -> Written:
    """Links (a, b) between hashes of distinct lines within the edit limit, enough to tie each class."""
    spark = docs_text.sparkSession
    meeting = Written(mapped(_by_key(_tiled(docs_text, places, tile)), _meeting, "key long, line_id long, role byte"), "meeting")
    release(spark)
    wanted = Written(meeting.df.select("line_id").distinct(), "wanted")
    texts = Written(_texts(docs_text, wanted.df), "texts")
    both = meeting.df.join(texts.df, "line_id").select("key", "line_id", "role", "line")
    found = Written(mapped(_by_key(both), _verified, "a long, b long"), "line-links")
    for x in (meeting, wanted, texts):
        x.drop()
    release(spark)
    return found


def line_classes(keyed: DataFrame) -> DataFrame:
    """keyed: doc_id, key_a, key_b, text. (key_a, key_b, lines): structs (at, class, gone) of lines that take part."""
    places = Written(_occurrences(keyed), "places")
    links = line_links(keyed.select("text"), places.df)
    roots = Written(components(links.df).select(F.col("node").alias("line_id"), F.col("root")), "roots")
    links.drop()
    rows = places.df.drop("keys").join(small(roots.df), "line_id", "left").withColumn("class", F.coalesce("root", "line_id")).drop("root")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key_a", "key_b", "at")
    several = rows.groupBy("class").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    several = Written(several.select("class", "first"), "several")
    gone = F.coalesce(place != F.col("first"), F.lit(False)).alias("gone")
    marked = rows.join(several.df, "class", "left").select("key_a", "key_b", F.struct("at", "class", gone).alias("line"))
    out = Written(marked.groupBy("key_a", "key_b").agg(F.sort_array(F.collect_set("line")).alias("lines")), "lines")
    for x in (places, roots, several):
        x.drop()
    release(keyed.sparkSession)
    return out.df


def _kept(text: F.Column, lines: F.Column) -> F.Column:
    drop = F.transform(F.filter(lines, lambda x: x["gone"]), lambda x: x["at"])
    return F.when(F.size(drop) <= 0, text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda _, k: ~F.array_contains(drop, k)), "\n"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (that take part), n_removed, line_classes (class ids in line order) and the kept text."""
    rows = docs.select("doc_id", "text")
    rows = rows.select("doc_id", *row_key(rows), "text")
    found = rows.join(line_classes(rows), ["key_a", "key_b"], "left")
    none = F.array().cast("array<struct<at:int,class:bigint,gone:boolean>>")
    found = found.withColumn("lines", F.coalesce("lines", none))
    removed = F.size(F.filter("lines", lambda x: x["gone"])).cast("long")
    classes = F.transform("lines", lambda x: x["class"])
    return found.select("doc_id", F.size("lines").cast("long").alias("n_lines"), removed.alias("n_removed"), classes.alias("line_classes"), _kept(F.coalesce("text", F.lit("")), F.col("lines")).alias("kept"))


def documents_without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without later lines of a class; a document of which only blanks stay goes too.

    A column called ``n_chars`` is set to the new text's length.
    """
    rows = packed(docs).select("row", "key_a", "key_b", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    found = packed(docs).join(line_classes(rows.select("doc_id", "key_a", "key_b", "text")), ["key_a", "key_b"], "left")
    text = F.when(F.col("lines").isNull(), F.col("row.text")).otherwise(_kept(F.col("row.text"), F.col("lines")))
    found = found.select("row", text.alias("new"), F.coalesce(F.exists("lines", lambda x: x["gone"]), F.lit(False)).alias("cut"))
    found = found.where(~F.col("cut") | (F.btrim("new", F.lit(SPACES)) != ""))
    cols = [F.col("new").alias(c) if c == "text" else F.length("new").cast(t).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c, t in docs.dtypes]
    return found.select(*cols)
