"""Rule bitmask ledger (native: DataFrame functions only).

Every rule is evaluated once. The ledger keeps the measurements and one long of failure bits per document;
a versioned policy is a mask over those bits, so another policy, or an ablation, needs the ledger only.

Defined cases: a null text counts as empty and fails ``few_words``; equal rows get equal ledgers; an empty
table gives an empty ledger; further columns of the input are not read. Repeated windows are compared by a
64-bit hash of their five words within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACE_RUN, SPACES, packed, text_or_empty

WINDOW = 5

#: Rule name and its failure condition over the measurements; a rule's bit is its place in this list.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 16 * n_words"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]

#: Policy version and the rules that reject under it.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["repeated_lines"],
    "v2": BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["short_words"] | BIT["long_words"],
}
PRODUCTION = "v2"


def _measure(df: DataFrame, text: Column) -> DataFrame:
    """Adds the measurements. Each step is its own projection, so that arrays are built once."""
    df = df.withColumn("t", text)
    df = df.withColumn("trimmed", F.btrim("t", F.lit(SPACES)))
    none = F.array().cast("array<string>")
    df = df.withColumn("words", F.when(F.col("trimmed") == "", none).otherwise(F.split("trimmed", SPACE_RUN)))
    df = df.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    df = df.select(
        *[c for c in df.columns if c not in ("trimmed", "lines")],
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.octet_length("t") - F.octet_length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    at = lambda i: [F.get("words", i + k) for k in range(WINDOW)]
    hashes = F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*at(i)))
    df = df.withColumn("hashes", F.when(F.col("n_words") >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    repeats = F.size("hashes") > F.size(F.array_distinct("hashes"))
    pairs = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("pairs", F.when(repeats, pairs))
    same = lambda p, k: p["h"] == F.get("pairs", k)["h"]
    twice = F.filter("pairs", lambda p, k: same(p, k - 1) | same(p, k + 1))
    df = df.withColumn("starts", F.when(F.col("pairs").isNotNull(), F.sort_array(F.transform(twice, lambda p: p["i"]))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
    covered = F.aggregate("starts", zero, step, lambda a: a["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return df.drop("t", "words", "hashes", "pairs", "starts")


def _with_bits(df: DataFrame) -> DataFrame:
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return df.withColumn("fail_bits", bits)


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measurements and ``fail_bits``, one row per row of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t0"))
    return _with_bits(_measure(rows, text_or_empty("t0")).drop("t0"))


def apply_policy(rows: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """``base_failed``, ``kept`` and ``policy`` from the stored bits."""
    hit = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) != 0
    return rows.withColumns({"base_failed": hit(BASE), "kept": ~hit(BASE | POLICIES[policy]), "policy": F.lit(policy)})


def ablation(rows: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """For each rule of a policy: documents failing it, failing it alone, and kept if it were dropped.

    The ledger is grouped by its masked bits first (at most two to the number of rules rows).
    """
    mask = POLICIES[policy]
    groups = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BIT.items() if b & mask]))
    each = groups.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    n_if = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return each.groupBy("rule").agg(
        n_if(F.col("bits").bitwiseAND(F.col("bit")) != 0)("n_failed"),
        n_if(F.col("bits") == F.col("bit"))("n_failed_alone"),
        n_if((F.col("bits") == 0) | (F.col("bits") == F.col("bit")))("n_kept_without"),
    )


def keep_documents(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns."""
    rows = packed(docs).select("row")
    found = apply_policy(_with_bits(_measure(rows, F.coalesce(F.col("row.text"), F.lit("")))), policy)
    # a column that is not deterministic keeps the optimizer from inlining the measurements into the filter,
    # where each use would compute the word arrays again
    found = found.withColumn("turn", F.monotonically_increasing_id())
    return found.where(F.col("kept") & (F.col("turn") >= 0)).select("row.*")
