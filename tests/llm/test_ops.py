"""The corpus operators against plain versions, on small fixtures and the small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import ann, components, line_join, mixing, packing, quality, queries, sentence_spans, simhash, suffix, token_counts, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, ties, repeated rows, clashing columns."""
    long = "one two three four five six seven eight nine ten eleven twelve. " * 400
    rows = [(1, "aa bb cc dd ee ff gg hh ii jj kk", "en", "s1", 1), (2, None, None, None, None), (None, "x y z " * 50, "en", None, 3), (4, "", "en", "", 0), (1, "aa bb cc dd ee ff gg hh ii jj kk", "en", "s1", 1), (5, long, "en", "s2", 9), (6, long, "en", "s2", 9), (7, " \n\t ", "xx", "s1", 2), (8, "é" * 500, "fr", "s3", 500)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 AS size", "'k' AS key_a", "2 AS fp", "3 AS row", "4 AS t", "5 AS words", "6 AS lines", "7 AS copies")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1


def test_mix_totals_and_targets(spark, sf, documents):
    rows = queries.op1_cube_mixing(spark, sf).collect()
    sizes = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in documents}
    assert {r.doc_id: r.size for r in rows} == sizes
    total, by = sum(sizes.values()), Counter()
    for d in documents:
        by[d["source"]] += sizes[d["doc_id"]]
    names = sorted(by, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(total)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * by[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 3.0 * by[s]
            rest -= target[s]
        open_ -= over
    taken = Counter()
    for r in rows:
        assert abs(r.target - target[r.source]) < 1e-6 * total and r.source_size == by[r.source]
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 0.002 * by[s] + 50
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op1_cube_mixing(spark, sf).collect()))


@given(st.lists(st.tuples(st.integers(0, 1000), st.floats(0, 1)), max_size=60), st.integers(0, 9))
@settings(max_examples=60, deadline=None)
def test_flight_keeps_both_balances(units, seed):
    import random

    sizes, p = [float(s) for s, _ in units], [x for _, x in units]
    before = (sum(p), sum(s * x for s, x in zip(sizes, p)))
    live = mixing.flight(sizes, p, random.Random(seed))
    assert len(live) <= 2 and all(x in (0.0, 1.0) for k, x in enumerate(p) if k not in live)
    assert sum(p) == pytest.approx(before[0], abs=1e-4) and sum(s * x for s, x in zip(sizes, p)) == pytest.approx(before[1], abs=0.1)


def test_mix_targets_of_odd_sources(spark):
    """A null source comes last and weighs as such; with no words every target is 0."""
    rows = [(k, "w " * 10, s, "en", 1) for s, n in (("a", 30), ("b", 20), (None, 50)) for k in range(n)]
    df = spark.createDataFrame([(d, t, lang, s, n) for d, t, s, lang, n in rows], DOCS)
    got = {(r.source, r.source_size, round(r.target, 6)) for r in mixing.mix(df).collect()}
    assert got == {("a", 300, 625.0), ("b", 200, 250.0), (None, 500, 125.0)}
    none = mixing.mix(spark.createDataFrame([(1, " ", "en", "a", 1), (2, None, "en", None, 1)], DOCS)).collect()
    assert {(r.doc_id, r.target, r.taken, r.copies) for r in none} == {(1, 0.0, 0, 0), (2, 0.0, 0, 0)}


def test_mix_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 9 and {r.doc_id for r in rows} == {1, 2, 4, 5, 6, 7, 8, None}
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mixed_documents(empty).count() == 0


# 2


def test_warc_round_trip(spark, tmp_path):
    big, small = "é" * 700, "tiny"
    rows = [(1, "http://a/ b", big), (2, None, big), (9, "http://c/\r\nX: y", big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", "\r\n\r\nWARC/1.1" * 5), (None, "u", big), (7, "u", "z" * 1000), (8, "u", "z" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest = warc.write_warc(pages, f"file://{tmp_path}/w", chunk=64)
    found = warc.read_warc(spark, manifest, chunk=50).collect()
    text = defaultdict(bytes)
    last = {}
    for r in sorted(found, key=lambda r: r.chunk_no):
        text[r.page_id] += r.data
        if r.last:
            last[r.page_id] = r
    for page, _, html in rows:
        raw = (html or "").encode()
        r = last[page]
        assert (r.n, r.sha1, r.agrees) == (len(raw), hashlib.sha1(raw).hexdigest(), True)
        assert (r.record_type, r.refers_to) == (("revisit", 9) if html == big and page in (1, 2) else ("response", None))
        if r.record_type == "response":
            assert text[page] == raw
    assert sum(m.records for m in manifest.collect()) == len(rows)


def test_warc_query(spark, sf):
    pages = {p["page_id"]: (p["html"] or "").encode() for p in pq.read_table(f"{sf}/pages.parquet").to_pylist()}
    rows = queries.op2_warc_chunks(spark, sf).collect()
    assert {(r.page_id, r.payload_bytes, r.payload_digest) for r in rows} == {(k, len(v), hashlib.sha1(v).hexdigest()) for k, v in pages.items()}
    least = {}
    for k, v in pages.items():
        if len(v) >= 1000:
            least[v] = max(k, least.get(v, k))
    for r in rows:
        first = least.get(pages[r.page_id], r.page_id)
        assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(spark, warc.write_warc(pages)).count() == 0


# 3


def check_packing(rows, texts, window=4096):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            raw = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert zlib.crc32(raw) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing_query(spark, sf, documents):
    rows = [r.asDict() for r in queries.op3_bin_slack_packing(spark, sf).collect()]
    assert check_packing(rows, {d["doc_id"]: d["text"] for d in documents}) == 0


def test_packing_odd_texts():
    ids_of = packing.WordIds(packing.tokenizer_path("word_bpe_49k.json"))
    texts = ["汉字" * 5000 + " ok", "<|endoftext|> a<|endoftext|>b", "ΑΣ ΟΔΟΣ x y\x1cz \x85w", "é İstanbul ǅ", "", None, "don't 12345 ...!!", "日本語テキスト 漢字", "word " * 30000]
    rows = [dict(zip(("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"), r), ids_crc32=zlib.crc32(r[-1])) for r in packing.packed_rows(enumerate(texts), ids_of)]
    assert check_packing(rows, dict(enumerate(texts))) == 0


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 4), max_size=8), st.integers(1, 64))
@settings(max_examples=150, deadline=None)
def test_fill_is_least_slack(counts, capacity):
    found = packing.fill(counts, capacity)
    assert all(k <= counts[n] for n, k in found.items())
    first = max((n for n in counts if n <= capacity), default=0)
    sums = {first} if first else {0}
    for n, c in counts.items():
        c -= n == first
        sums |= {s + n * k for s in sums for k in range(c + 1) if s + n * k <= capacity}
    assert sum(n * k for n, k in found.items()) == max(sums)


# 4


def plain_sentences(text):
    lines = re.sub(r"([.!?])[\x20\x09-\x0D]", "\\1\n", text or "").split("\n")
    return [w for x in lines if (w := WORD.findall(x))]


def plain_spans(docs, run, least, long):
    """Numbers of sentences that a run covers which is not at its first place."""
    places = defaultdict(list)
    for doc, text in docs.items():
        s = plain_sentences(text)
        runs = {(k, k + 1) for k, w in enumerate(s) if len(w) >= long}
        for k in range(len(s)):
            ahead = [j for j in range(k + run, len(s) + 1) if sum(map(len, s[k:j])) >= least]
            back = [i for i in range(k + 1 - run, -1, -1) if sum(map(len, s[i : k + 1])) >= least]
            runs |= {(k, j) for j in ahead[:1]} | {(i, k + 1) for i in back[:1]}
        for i, j in runs:
            places[tuple(map(tuple, s[i:j]))].append((doc, i, j))
    gone = defaultdict(set)
    for found in places.values():
        for doc, i, j in sorted(found)[1:]:
            gone[doc] |= set(range(i, j))
    return gone


def test_sentence_spans(spark, sf, documents):
    texts = {d["doc_id"]: d["text"] for d in documents}
    gone = plain_spans(texts, sentence_spans.RUN, sentence_spans.MIN_WORDS, sentence_spans.LONG)
    for r in queries.op4_sentence_spans(spark, sf).collect():
        assert r.n_removed == len(gone[r.doc_id])
        assert r.kept == sentence_spans.kept_text(texts[r.doc_id], gone[r.doc_id])[-1]
        assert (r.n_removed > 0) == (r.kept != texts[r.doc_id])


def test_sentence_spans_sql(documents, sf):
    """The SQL beside the query against the plain rule."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    texts = {d["doc_id"]: d["text"] for d in documents}
    gone = plain_spans(texts, sentence_spans.RUN, sentence_spans.MIN_WORDS, sentence_spans.LONG)
    for r in con.execute(queries.ORACLE_SQL["op4_sentence_spans"]).fetchall():
        assert r[1:] == sentence_spans.kept_text(texts[r[0]], sorted(gone[r[0]]))


def test_sentence_spans_odd(odd, empty):
    rows = sentence_spans.remove_repeated_sentences(odd).collect()
    assert len(rows) == 9 and sentence_spans.remove_repeated_sentences(empty).count() == 0
    # of two rows with one text the first keeps its first run, a row given twice keeps the same in both
    assert {r.doc_id for r in rows if r.n_removed} == {5, 6}
    assert {(r.n_removed, r.kept) for r in rows if r.doc_id == 1} == {(0, "aa bb cc dd ee ff gg hh ii jj kk")}


def test_sentence_spans_of_short_sentences(spark):
    """A passage of over 50 words in sentences of three stays once only, to its last sentence."""
    verse = [f"{a} {b} end" for a, b in zip("one two three four five six seven eight nine ten eleven twelve lamb wolf bear fox hen owl".split(), "red blue green white black brown grey pink gold plum rose teal mint sand rust wine jade onyx".split())]
    docs = [(1, "Alpha opens here\n" + "\n".join(verse) + "\nAlpha closes here"), (2, "Beta opens there\n" + "\n".join(verse) + "\nBeta closes there")]
    rows = {r.doc_id: r for r in sentence_spans.remove_repeated_sentences(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[1].n_removed == 0 and rows[1].kept == docs[0][1]
    assert rows[2].n_removed == len(verse) and rows[2].kept == "Beta opens there\nBeta closes there"


# 5


def plain_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(t)
    sh = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(fps):
    root = {d: d for d in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    v = np.array([fps[d] for d in ids], np.uint64)
    for i, d in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= 3):
            a, b = top(d), top(ids[i + 1 + j])
            root[max(a, b)] = min(a, b)
    return {d: top(d) for d in ids}


def test_simhash_query(spark, sf, documents):
    fps = {d["doc_id"]: plain_fingerprint(d["text"]) for d in documents}
    want = plain_components(fps)
    rows = queries.op5_simhash_pivots(spark, sf).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in rows} == {d: (fps[d], want[d]) for d in fps}
    assert all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in rows)


@pytest.mark.parametrize("tile", [50_000, 40])
def test_simhash_links_on_clusters(spark, tile):
    rng = np.random.default_rng(3)
    fps = []
    for _ in range(60):
        c = int(rng.integers(0, 1 << 63))
        for _ in range(12):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            fps.append(x)
    fps = list(dict.fromkeys([*fps, 0, 1, 7, 15, (1 << 64) - 1]))
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.root for r in components.components(simhash.links(df, tile=tile)).collect()}
    want = plain_components(dict(zip(signed, fps)))
    assert {x: got.get(x, x) for x in signed} == want


def test_simhash_odd(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 9 and simhash.near_duplicates(empty).count() == 0
    assert {r.component_id for r in rows if r.fp == 0} == {2}


def test_simhash_without_ids(spark):
    """Rows without doc_id are linked like others, but name no component; extra columns are not read."""
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(None, text), (None, text + " nu xi omicron pi rho"), (7, "quite other words stand here than anywhere else in this table"), (None, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS bucket", "3 AS root").repartition(3)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 5 and {r.component_id for r in got if r.fp == 0} == {9}
    assert {r.component_id for r in got if r.doc_id is None and r.fp != 0} == {None}


def test_keys_of_nested_maps(spark):
    from quire.llm.common import row_key

    df = spark.sql("SELECT named_struct('m', map('a', 1)) AS x, 1 AS id UNION ALL SELECT named_struct('m', map('a', 2)), 1 UNION ALL SELECT named_struct('m', map('a', 1)), 1")
    assert df.select(*row_key(df)).distinct().count() == 2


def test_components_on_paths(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100 + k, 99 + k) for k in range(2, 30)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 101 for k in range(101, 130)}}


# 6


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(0, 3))
@settings(max_examples=400, deadline=None)
def test_within_is_the_edit_distance(a, b, t):
    assert line_join.within(a, b, t) == (edit_distance(a, b) <= t)


@given(st.text("ab", min_size=40, max_size=90), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 89), st.sampled_from("abc")), max_size=2))
@settings(max_examples=200, deadline=None)
def test_linked_lines_meet_under_a_key(a, ops):
    b = a
    for kind, at, c in ops:
        at = min(at, len(b))
        b = b[:at] + c + b[at:] if kind == 0 else b[:at] + b[at + 1 :] if kind == 1 else b[:at] + c + b[at + 1 :]
    if edit_distance(a, b) > line_join.edits(min(len(a), len(b))):
        return
    keys = lambda s, bit: {(seed, s[i:j]) for seed, i, j, r in line_join.probes(len(s)) if r & bit}
    short, longer = sorted((a, b), key=len)
    assert keys(short, 1) & keys(longer, 2)
    gap = line_join.sketch_gap(*(line_join.sketches([s]) for s in (a, b)))[0]
    assert gap <= 2 * edit_distance(a, b)


def plain_lines(docs):
    lines = defaultdict(list)
    for doc, text in docs.items():
        for k, s in line_join.lines_of(text):
            lines[s].append((doc, k))
    names = sorted(lines, key=len)
    root = {s: s for s in names}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if len(b) > len(a) + 2:
                break
            t = line_join.edits(len(a))
            if t and top(a) != top(b) and sum((Counter(a) - Counter(b)).values()) <= t and edit_distance(a, b) <= t:
                root[top(b)] = top(a)
    groups = defaultdict(list)
    for s in names:
        groups[top(s)] += lines[s]
    return {place for g in groups.values() for place in sorted(g)[1:]}


def test_line_join(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda"]
    base = [" ".join(rng.choice(words, rng.integers(4, 22))) for _ in range(60)]
    docs = {}
    for d in range(80):
        out = []
        for _ in range(6):
            s = list(base[rng.integers(0, 60)])
            for _ in range(rng.integers(0, 4)):
                at = int(rng.integers(0, len(s)))
                s[at : at + int(rng.integers(0, 2))] = rng.choice(list("xé,"))
            out.append("".join(s))
        docs[d] = "\n".join(out)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    gone = plain_lines(docs)
    rows = line_join.dedup_lines(df).collect()
    for r in rows:
        want = [s for k, s in enumerate(docs[r.doc_id].split("\n")) if (r.doc_id, k) not in gone]
        assert r.kept == "\n".join(want) and r.n_removed == 6 - len(want) and len(r.line_classes) == r.n_lines
    classes = {}
    for r in rows:
        for (k, s), c in zip(line_join.lines_of(docs[r.doc_id]), r.line_classes):
            assert classes.setdefault(s, c) == c


def test_segment_keys():
    rng = np.random.default_rng(4)
    lines = ["".join(rng.choice(list("abcdé中 "), rng.integers(40, 260))) for _ in range(60)]
    key, role, line = line_join.segment_keys(lines)
    flat = [(k, seed, s[i:j], r) for k, s in enumerate(lines) for seed, i, j, r in line_join.probes(len(s))]
    assert [x[0] for x in flat] == line.tolist() and [x[3] for x in flat] == role.tolist()
    names = {}
    for x, k in zip(flat, key.tolist()):
        assert names.setdefault(x[1:3], k) == k
    assert len(set(names.values())) == len(names)


def test_within_long_lines():
    rng = np.random.default_rng(6)
    a = "".join(rng.choice(list("abcdefg "), 1_000_000))
    assert line_join.within(a, "x" + a[1:-1] + "y", 2) and not line_join.within(a, "x" + a[1:500] + a[501:-1] + "y", 2)


@pytest.mark.parametrize("tile", [50_000, 3])
def test_line_links_by_tiles(spark, tile):
    rng = np.random.default_rng(8)
    base = "".join(rng.choice(list("abcdefgh "), 120))
    lines = {base}
    for _ in range(40):
        s = list(base)
        for at in rng.integers(0, 120, 3):
            s[int(at)] = str(rng.choice(list("abcdefgh")))
        lines.add("".join(s).strip())
    lines = sorted(lines)
    df = spark.createDataFrame([(s,) for s in lines], "text string")
    ids = {line_join.line_hash(s): s for s in lines}
    keys = [(line_join.segment_keys([s])[0].tolist(),) for s in lines for _ in range(1 + 16 // tile)]
    places = spark.createDataFrame(keys, "keys array<long>")
    got = {r.node: r.root for r in components.components(line_join.line_links(df, places, tile).df).collect()}
    root = {s: s for s in lines}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in lines:
        for b in lines:
            if a < b and edit_distance(a, b) <= line_join.edits(min(len(a), len(b))):
                root[top(b)] = top(a)
    classes = defaultdict(set)
    for h, s in ids.items():
        classes[got.get(h, h)].add(s)
    want = defaultdict(set)
    for s in lines:
        want[top(s)].add(s)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values())) and len(want) < len(lines)


def test_line_join_query(spark, sf, documents):
    texts = {d["doc_id"]: d["text"] for d in documents}
    gone = plain_lines(texts)
    for r in queries.op6_line_edit_join(spark, sf).collect():
        lines = texts[r.doc_id].split("\n")
        assert r.kept == "\n".join(s for k, s in enumerate(lines) if (r.doc_id, k) not in gone)
        assert r.n_lines == sum(1 for _ in line_join.lines_of(texts[r.doc_id]))


def test_line_join_odd(odd, empty):
    rows = line_join.dedup_lines(odd).collect()
    assert len(rows) == 9 and line_join.dedup_lines(empty).count() == 0
    assert {(r.n_lines, r.n_removed, r.kept) for r in rows if r.doc_id == 1} == {(1, 0, "aa bb cc dd ee ff gg hh ii jj kk")}
    assert [(r.n_lines, r.n_removed) for r in sorted(rows, key=lambda r: r.doc_id or 0) if r.doc_id in (5, 6)] == [(1, 0), (1, 1)]
    kept = line_join.documents_without_repeats(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2, 4, 5, 7, 8]


def test_short_lines_outlive_a_repeated_line(spark):
    """Only a document of which blanks stay goes; lines too short to take part are no repeats."""
    licence = "All of this text is free to copy and share."
    docs = [(1, licence), (2, f"a red fox\n{licence}\nran home"), (3, f" \n{licence}\n"), (4, "tiny"), (5, "")]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], DOCS)
    assert {r.doc_id: r.text for r in line_join.documents_without_repeats(df).collect()} == {1: licence, 2: "a red fox\nran home", 4: "tiny", 5: ""}


# 7


def test_ledger_odd(odd, empty, spark):
    rows = {(r.doc_id, r.n_words): r for r in quality.apply_policy(quality.ledger(odd)).collect()}
    assert rows[2, 0].base_failed and not rows[2, 0].kept and rows[1, 11].kept
    assert rows[5, 4800].n_repeat_words == 4800 and rows[None, 150].n_repeat_words == 150
    assert quality.ledger(empty).count() == 0
    kept = quality.keep_documents(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()] == [1, 1]


def test_ablation(odd):
    ledger = quality.apply_policy(quality.ledger(odd))
    rows = ledger.collect()
    for r in quality.ablation(ledger).collect():
        bit, mask = quality.BIT[r.rule], quality.POLICIES[quality.PRODUCTION]
        assert r.n_failed == sum(x.fail_bits & mask & bit > 0 for x in rows)
        assert r.n_kept_without == sum(x.fail_bits & mask & ~bit == 0 for x in rows)


# 8


def test_token_counts(spark, sf, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in queries.op8_pretoken_counts(spark, sf).collect()}
    for d in documents:
        n = len(tok.encode(d["text"] or "", add_special_tokens=False).ids)
        assert tuple(rows[d["doc_id"]]) == (d["doc_id"], len((d["text"] or "").encode()), n, n > 512)


@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sé’ \x1c\x85")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_piece_counter_is_the_library(text):
    global COUNTER
    if "COUNTER" not in globals():
        COUNTER = token_counts.PieceCounter(packing.tokenizer_path("byte_bpe_50k.json"))
    assert COUNTER(text) == len(COUNTER.tok.encode(text, add_special_tokens=False).ids)
    t = text + "<|endoftext|>" + text
    assert COUNTER(t) == len(COUNTER.tok.encode(t, add_special_tokens=False).ids)


SCRIPTS = ["我们在这里，看书。学习中文！", "Ελληνικά γράμματα, ἀρχή. ", "Русские слова и цифры 123. ", "emoji 😀😃 👩‍👩‍👧 ok! ", "\0\0 nul￿ ", "ไทยไม่มีช่องว่าง ", "€ → ≤ x́ 　 हिन्दी "]


@pytest.mark.parametrize("text", [*SCRIPTS, "".join(SCRIPTS)])
def test_piece_counter_on_long_texts_of_every_script(text, monkeypatch):
    monkeypatch.setattr(token_counts, "PART", 5_000)
    count = token_counts.PieceCounter(packing.tokenizer_path("byte_bpe_50k.json"))
    long = text * (100_000 // len(text)) + "<|endoftext|>" + text
    assert list(token_counts.parts(long, 5_000)) != [] and "".join(token_counts.parts(long, 5_000)) == long
    assert count(long) == len(count.tok.encode(long, add_special_tokens=False).ids)
    assert count.memo.size <= token_counts.MEMO


def test_memo_is_bounded_by_bytes():
    from quire.llm.common import Memo

    memo = Memo(10_000)
    for k in range(1000):
        for x in memo.missing([f"piece {k}", f"piece {k // 2}"]):
            memo.put(x, k)
        assert len(memo.new) <= 10_000 // Memo.ENTRY + 2 and f"piece {k}" in memo.new


def test_token_counts_odd(odd, empty):
    rows = token_counts.count_tokens(odd).collect()
    assert len(rows) == 9 and token_counts.count_tokens(empty).count() == 0
    assert {tuple(r)[1:] for r in rows if r.doc_id in (2, 4)} == {(0, 0, False)}


# 9


def plain_repeats(texts, length):
    seen = defaultdict(list)
    for d, raw in enumerate(texts):
        for k in range(len(raw) - length + 1):
            seen[raw[k : k + length]].append((d, k))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, k in places:
                gone[d][k : k + length] = True
    out = []
    for t, g in zip(texts, gone):
        x = np.frombuffer(t, np.uint8)
        edges = np.diff(np.concatenate(([0], g.astype(int), [0])))
        out.append((len(t), int(g.sum()), int((edges == 1).sum()), hashlib.sha256(x[~g].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [10_000, 1])
def test_suffix_small(spark, hot):
    rng = np.random.default_rng(11)
    letters = np.frombuffer(b"abcdefghij klm", np.uint8)
    rand = lambda n: letters[rng.integers(0, 14, n)].tobytes()
    passages = [rand(n) for n in (39, 40, 41, 60, 150, 300)]
    texts = []
    for _ in range(60):
        t = rand(int(rng.integers(0, 200)))
        for _ in range(int(rng.integers(0, 3))):
            p = passages[rng.integers(0, 6)]
            a = int(rng.integers(0, 20))
            t += p[a : len(p) - int(rng.integers(0, 10))] + rand(int(rng.integers(0, 60)))
        texts.append(t)
    texts += [b"a" * 500, b"ab" * 200, b"x" * 41, texts[3], texts[3], b"", rand(2000) * 2]
    df = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = suffix.remove_repeats(df, 40, reach=25, gram=4, hot=hot).collect()
    want = plain_repeats(texts, 40)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) == want[r.doc_id], r.doc_id


def test_multikey_order():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, (5000, 6)).astype(np.uint64) << np.uint64(60)
    assert [tuple(r) for r in words[suffix.multikey_order(words)].tolist()] == sorted(map(tuple, words.tolist()))


def test_suffix_hot_head(spark):
    """Very many contexts behind one long head, in one bucket and over several, with repeats among them."""
    rng = np.random.default_rng(12)
    rand = lambda n: rng.integers(97, 110, n).astype(np.uint8).tobytes()
    head = rand(120)
    texts = [rand(int(rng.integers(0, 30))) + head + rand(60) for _ in range(300)]
    texts += [rand(5) + t[3:] for t in texts[:40]]
    df = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = plain_repeats(texts, 40)
    for hot in (10_000, 20):
        for r in suffix.remove_repeats(df, 40, reach=25, gram=4, hot=hot).collect():
            assert (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) == want[r.doc_id], (hot, r.doc_id)


def test_suffix_query(spark, sf, documents):
    texts = [d["text"].encode() for d in documents]
    length, count = 400, Counter()
    for t in texts:
        count.update(hash(t[k : k + length]) for k in range(len(t) - length + 1))
    rows = {r.doc_id: r for r in queries.op9_suffix_dedup(spark, sf).collect()}
    for d, t in zip(documents, texts):
        g = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if count[hash(t[k : k + length])] > 1:
                g[k] += 1
                g[k + length] -= 1
        g = np.cumsum(g)[:-1] > 0
        kept = np.frombuffer(t, np.uint8)[~g].tobytes()
        r = rows[d["doc_id"]]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(t), int(g.sum()), hashlib.sha256(kept).hexdigest())


def test_suffix_length(spark, tmp_path):
    """Bytes decide, not words: a passage of 57 words and 399 bytes stays; one word of 400 bytes goes, within characters too."""
    words = " ".join(f"{k:06d}" for k in range(57)) + "x"
    word, tail = "".join(f"{k:04d}" for k in range(100)), "".join(f"{k:03d}" for k in range(133))
    texts = ["a" + words + "b", "c" + words + "d", "a" + word + "b", "c" + word + "d", "\u00e9" + tail, "\u0129" + tail, None]
    kept = [texts[0].encode(), texts[1].encode(), b"ab", b"cd", b"\xc3", b"\xc4", b""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: tuple(r) for r in queries.op9_suffix_dedup(spark, str(tmp_path)).collect()}
    for k, rest in enumerate(kept):
        n = len((texts[k] or "").encode())
        assert rows[k] == (k, n, n - len(rest), int(n > len(rest)), hashlib.sha256(rest).hexdigest())


def test_suffix_odd(odd, empty):
    rows = suffix.remove_repeats(odd).collect()
    assert len(rows) == 9 and suffix.remove_repeats(empty).count() == 0
    assert {r.doc_id for r in rows if r.n_removed == r.n_bytes > 0} == {5, 6, 8}


def test_anchor_blocks():
    x = np.random.default_rng(1).integers(0, 4, (1 << 20) + 5000).astype(np.uint8)
    a, lo, hi = suffix.anchors(x, 400, 300, 16)
    assert lo[0] == 0 and hi[-1] == len(x) - 400 and (lo[1:] == hi[:-1] + 1).all() and ((a >= hi) & (a < lo + 300)).all()


# 10


def test_ann_recall(spark, sf):
    table = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{sf}/embeddings.parquet").to_pylist()]
    ids, x = np.array([v for v, _ in table]), np.array([e for _, e in table], float)
    rows = defaultdict(list)
    for r in queries.op10_additive_ann(spark, sf).collect():
        rows[r.query_id].append(r)
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        best = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        got = sorted(rows[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 11)) and [r.score for r in got] == sorted(r.score for r in got)
        for r in got:
            assert r.score == pytest.approx(float(d[ids == r.vec_id][0]), rel=1e-12)
        hits += len({r.vec_id for r in got} & set(ids[best].tolist()))
        total += 10
    assert hits >= 0.9 * total


def test_ann_recall_beyond_one_block():
    """Vectors without structure, the hardest ones to quantise, in several blocks of rows."""
    rng = np.random.default_rng(2)
    x, ids = rng.normal(size=(20_000, 64)), np.arange(20_000)
    books = ann.train(x[:8192])
    codes = ann.encode(x, books)
    norm = (ann.decode(codes, books) ** 2).sum(axis=1)
    q = ids[::400]
    found = ann.Nearest(len(q), 10)
    for at in range(0, len(x), ann.ROWS):
        b = slice(at, at + ann.ROWS)
        ann.score_block(x[q], q, codes[b], norm[b], ids[b], x[b], books, found, ann.RERANK)
    hits = 0
    for i, k in enumerate(q):
        d = ((x - x[k]) ** 2).sum(axis=1)
        d[k] = np.inf
        hits += len(set(found.ids[i].tolist()) & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 10 * len(q)


def test_ann_odd(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (100, [1.0, 1.0]), (100, [1.0, 1.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, 1.0), (0, 4, 100, 1.0), (100, 1, 0, 1.0), (100, 2, 1, 1.0), (100, 3, 2, 1.0)]
    assert ann.nearest(df.where("vec_id = 3")).count() == 0


def test_ann_repeated_query_and_clashing_columns(spark):
    """A query id with two vectors asks with the lesser one; columns named as the operator's own are not read."""
    rows = [(0, [3.0, 0.0], 1, 2.0), (0, [1.0, 0.0], 1, 2.0), (1, [1.0, 0.5], 1, 2.0), (2, [3.0, 0.1], 1, 2.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v long, score double").selectExpr("*", "7 AS norm", "8 AS codes", "9 AS rank", "10 AS part").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df).collect())
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 2)] and got[0][3] == 0.5


def test_warc_repeated_rows_and_clashing_columns(spark, tmp_path):
    big = "é" * 700
    rows = [(1, "u", big), (1, "u", big), (2, "u", big), (2, "u", big), (3, "u", None), (3, "u", None), (None, "u", "x" * 2000), (None, "u", "x" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS data", "2 AS digest", "3 AS n", "4 AS last", "5 AS refers_to", "6 AS key_a")
    found = warc.read_warc(spark, warc.write_warc(pages, f"file://{tmp_path}/w")).where("last").collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in found) == {(1, "revisit", 2): 2, (2, "response", None): 2, (3, "response", None): 2, (None, "response", None): 2}
