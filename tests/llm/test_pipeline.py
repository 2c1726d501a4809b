"""Each stage of the pipeline against a plain version on its own input, and on odd and empty tables."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from test_ops import DOCS, WORD, check_packing, empty, odd, plain_fingerprint, plain_lines  # noqa: F401

from quire.llm import line_join

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, the input first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [[r.asDict() for r in docs.collect()]]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        made = f(spark, docs, SF)
        if k < 4:
            assert made.columns == docs.columns
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append([r.asDict() for r in docs.collect()])
    return out


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def plain_keeps(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    chars = sum(map(len, w))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w) >= 10 and 100 * len(covered) <= 20 * len(w) and 10 * symbols <= len(w) and 2 * (len(lines) - len(set(lines))) <= len(lines) and 2 * len(w) <= chars <= 16 * len(w)


def test_quality(stages):
    assert texts(stages[1]) == {d: t for d, t in texts(stages[0]).items() if plain_keeps(t)}


def test_line_dedup(stages):
    before = texts(stages[1])
    gone = plain_lines(before)
    want = {}
    for d, t in before.items():
        mine = {k for doc, k in gone if doc == d}
        kept = "\n".join(s for k, s in enumerate(t.split("\n")) if k not in mine)
        if not mine or WORD.search(kept):
            want[d] = kept
    assert texts(stages[2]) == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2])


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_classes(docs):
    """The least id of each document's class, from all pairs."""
    sets = {d: shingles(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                a1, b1 = top(a), top(b)
                root[max(a1, b1)] = min(a1, b1)
    return {d: top(d) for d in docs}


def test_near_dedup(stages):
    before = texts(stages[2])
    roots = plain_classes(before)
    assert texts(stages[3]) == {d: before[d] for d in before if roots[d] == d}


def test_mixing(stages):
    sizes = {r["doc_id"]: (r["source"], len(WORD.findall(r["text"]))) for r in stages[3]}
    copies = Counter(r["doc_id"] for r in stages[4])
    assert set(copies) <= set(sizes) and max(copies.values()) <= 3
    total, by, taken = sum(n for _, n in sizes.values()), Counter(), Counter()
    for d, (s, n) in sizes.items():
        by[s] += n
        taken[s] += copies[d] * n
    largest = max(n for _, n in sizes.values())
    assert abs(sum(taken.values()) - total) <= 0.05 * total and all(taken[s] <= 3 * by[s] + largest for s in by)


def test_packing(stages):
    rows, seen = [], defaultdict(int)
    # copies of a document are told apart by counting its first pieces
    docs = Counter(r["doc_id"] for r in stages[4])
    tokens = {}
    for r in stages[5]:
        tokens.setdefault(r["doc_id"], r["doc_tokens"])
        seen[r["doc_id"]] += r["length"]
        rows.append(r)
    assert seen == {d: n * tokens[d] for d, n in docs.items()}
    once = {d for d, n in docs.items() if n == 1}
    text = texts(stages[4])
    alone = [r for r in rows if r["doc_id"] in once]
    sequences = defaultdict(int)
    for r in rows:
        sequences[r["sequence_id"]] += r["length"]
    assert all(n & (n - 1) == 0 for n in sequences.values())
    for r in alone:
        r["sequence_id"], r["offset"] = (r["sequence_id"], r["offset"]), 0
    check_packing(alone, {d: text[d] for d in once})


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r["doc_id"] for r in stages[5])


def test_odd_and_empty_tables(spark, odd, empty):  # noqa: F811
    for docs in (odd, empty):
        for k, (_, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, docs, SF)
            assert k == 4 or out.columns == docs.columns
            out.count()


def test_near_dedup_at_four_fifths(spark):
    """Near copies whose fingerprints lie further apart than op5's 3 bits, against all pairs by their sets."""
    import random

    rng = random.Random(8)
    docs, kinds = {}, [f"w{k}" for k in range(3000)]
    for base in range(25):
        words = rng.choices(kinds, k=rng.randint(30, 300))
        for copy in range(6):
            own = list(words)
            for _ in range(rng.randint(0, len(words) // 25 + 1) if copy else 0):
                own[rng.randrange(len(own))] = rng.choice(kinds)
            docs[base * 10 + copy] = " ".join(own)
    roots = plain_classes(docs)
    prints = {d: plain_fingerprint(t) for d, t in docs.items()}
    assert any((prints[d] ^ prints[r]).bit_count() > 3 for d, r in roots.items())
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs.items()], DOCS).repartition(5)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == {d for d, r in roots.items() if r == d}


def test_group_of_near_copies(spark):
    """Copies of one document that are not similar to each other are tied through it, with few pairs compared."""
    import random

    rng = random.Random(3)
    base = [f"v{k}" for k in range(400)]
    docs = {0: " ".join(base)}
    for copy in range(1, 60):
        own = list(base)
        for at in rng.sample(range(400), 8):
            own[at] = f"x{copy}-{at}"
        docs[copy] = " ".join(own)
    docs |= {100 + k: t + " tail" * k for k, t in enumerate(list(docs.values())[:3])}
    roots = plain_classes(docs)
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs.items()], DOCS).repartition(5)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == {d for d, r in roots.items() if r == d}


def test_near_dedup_tries_fingerprints(spark):
    """Sets with near fingerprints are tied by op5's links before anything else is compared."""
    import numpy as np

    from quire.llm import shingle_join

    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 40)]
    rows = [(k, fps[k % 40] ^ (0 if k < 80 else 1 << (k % 7) | 1 << 20)) for k in range(120)]
    df = spark.createDataFrame(rows, "node long, fp long")
    pairs = shingle_join._by_fingerprint(df, df.groupBy("fp").agg(F.min("node").alias("least"))).collect()
    root = list(range(120))
    for a, b in pairs:
        assert a < b and ((rows[a][1] ^ rows[b][1]) & ((1 << 64) - 1)).bit_count() <= 6
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = [new if r == old else r for r in root]
    assert root == [k % 40 for k in range(120)]
    found = shingle_join.shingle_set("a b c d e f g h i j k")
    bits = [sum(int(h) >> k & 1 for h in found) for k in range(64)]
    assert shingle_join.fingerprint(found) & ((1 << 64) - 1) == sum(1 << k for k, n in enumerate(bits) if 2 * n > len(found))
    assert shingle_join.fingerprint(shingle_join.shingle_set("")) == 0
