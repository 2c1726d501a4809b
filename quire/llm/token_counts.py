"""Token counts without ids: pieces are counted once per distinct pre-token.

A task keeps a table of distinct pre-tokens and their number of pieces, filled by the library for those it
has not seen. The documents' pre-token frequencies are joined to it inside the task and summed. Only the
counts leave the task, so nothing is shuffled; the table has a bounded size, and what is asked for again outlives what is not.

Pre-tokens are found here by the tokenizer's published pattern in texts of code points whose classes all
versions of the tables agree on; in any other text the library's own pre-tokenizer finds them, which knows
every script. A special token's string is one token, and the text before and after it is split alone. Long
texts are split in parts, cut where a pre-token ends in any case.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted alike; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import Memo, mapped, per_worker
from quire.llm.packing import tokenizer_path

LIMIT = 512
#: Bytes in each generation of the table.
MEMO = 64 << 20
#: Latin with its extensions and general punctuation, without unassigned places.
PLAIN = re.compile("[\\x00-\\x1b\\x20-\\x84\\x86-\\u0220\\u2010-\\u2027\\u2030-\\u205e]*")
#: Ends of pre-tokens whatever stands around: before a blank, and after ideographic marks before an ideograph.
SAFE = re.compile("[!-~](?= )|[\\u3001\\u3002\\uff0c](?=[\\u4e00-\\u9fa5])")
#: Before pre-tokens as the library shows them; no other pre-token holds it.
MARK = "\uffff"
#: The pre-tokenization pattern of this byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are split into pre-tokens in parts of about this many characters, to bound memory.
PART = 1 << 20

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def parts(text: str, size: int) -> Iterator[str]:
    """The text in parts of ``size`` or more characters, the last one shorter, whose pre-tokens are those of the text."""
    at = 0
    while len(text) - at > size and (m := SAFE.search(text, at + size)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


class PieceCounter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tok, self.memo = Tokenizer.from_file(path), Memo(MEMO)
        self.find = regex.compile(PATTERN).findall
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))).split

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens as the text has them, or, marked, as the library shows their bytes."""
        if PLAIN.fullmatch(text):
            return self.find(text)
        return [MARK + p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def counts(self, pieces: list[str]) -> list[int]:
        """Numbers of pieces the library's model cuts pre-tokens into."""
        plain = [p for p in pieces if p[0] != MARK]
        of = dict(zip(plain, map(len, self.tok.encode_batch_fast(plain, add_special_tokens=False))))
        return [of[p] if p[0] != MARK else len(self.tok.model.tokenize(p[1:])) for p in pieces]

    def __call__(self, text: str) -> int:
        if any(s in text for s in self.special):
            spans = self.split(text)
            return len(spans) - 1 + sum(map(self, spans))
        return sum(self.part(p) for p in parts(text, PART))

    def part(self, text: str) -> int:
        freq = Counter(self.pieces(text))
        long = 0
        new = self.memo.missing(freq)
        for p, n in zip(new, self.counts(new)):
            if len(p) > Memo.LONG:
                long += freq.pop(p) * n
            else:
                self.memo.put(p, n)
        count = self.memo.new
        return long + sum(n * count[p] for p, n in freq.items())


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit, one row per row of ``docs``."""

    def run(it):
        count = per_worker(("piece counts", vocabulary), lambda: PieceCounter(tokenizer_path(vocabulary)))
        for b in it:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = [count(t) for t in texts]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return mapped(docs.select("doc_id", "text"), run, SCHEMA, 500)
