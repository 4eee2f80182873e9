"""Token counts with overlap resynchronisation.

A huge text is cut into chunks that overlap. Chunks are encoded on their own, with the characters that each token covers,
and two neighbours are spliced at a token that both have at the same place in their overlap: both encodings go on alike from
there. Such a boundary is proven, not guessed: next to a blank, because no token spans a blank and the pre-tokenizer starts
afresh behind it; inside unsplit text, because every pair of neighbouring tokens of the spliced sequence is a pair of a valid
encoding. If an overlap holds no such token it is doubled and the chunks are encoded again.

Inside a chunk of an ordinary text the counts of single words are kept for reuse; blanks are proven boundaries as well.
"""

from __future__ import annotations

import os
import unicodedata
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from perilgrid.llm.bpe import vocabulary_path
from perilgrid.llm.runtime import ship, slices, texts_of

VOCABULARY = "word_bpe_49k.json"
CHUNK, OVERLAP, MARGIN = 32_768, 512, 16  # characters
LIMIT = 2048
#: Words whose counts are kept, and the longest of them: a bound in bytes as well (some 80 MB).
KEPT_WORDS, LONGEST = 600_000, 40


def stem(word: str) -> tuple[str, ...]:
    """Parts that are encoded apart, in a form that many words share: letters in lower case, and one comma or full stop behind
    a letter (a run of letters ends there, and letters are lower-cased by the vocabulary anyway). ASCII words only."""
    if not word.isascii() or "'" in word or "<" in word:
        return (word,)
    if word[-1:] in (",", ".") and word[-2:-1].isalpha():
        return word[:-1].lower(), word[-1]
    return (word.lower(),)


class ChunkCounter:
    """Counts the tokens of texts as the tokenizers library does with the same file (without added special tokens)."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.chunk, self.overlap, self.margin = chunk, overlap, margin
        self.known: dict[str, int] = {"": 0}

    def count(self, text: str) -> int:
        return self.chunked(text) if len(text) > self.chunk else self.words(text)

    def words(self, text: str) -> int:
        """The sum over blank-separated words, each encoded once."""
        words = text.replace("\n", " ").split(" ")
        known = self.known
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            pass
        if len(known) > KEPT_WORDS:
            known.clear()
            known[""] = 0
        new = {w: stem(w) for w in words if w not in known}
        stems = list({part for parts in new.values() for part in parts if part not in known})
        for part, got in zip(stems, self.library.encode_batch_fast(stems, add_special_tokens=False), strict=True):
            known[part] = len(got)
        for w, parts in new.items():
            known[w] = sum(map(known.__getitem__, parts))
        total = sum(map(known.__getitem__, words))
        for w in {*new, *stems}:
            if len(w) > LONGEST:
                del known[w]
        return total

    def encode(self, text: str, start: int, end: int) -> tuple[list[tuple[int, int, int]], int, int]:
        got = self.library.encode(text[start:end], add_special_tokens=False)
        return [(a + start, b + start, i) for (a, b), i in zip(got.offsets, got.ids, strict=True)], start, end

    def chunked(self, text: str) -> int:
        """Encodes overlapping chunks and splices them."""
        done = 0  # tokens before the splice that opened the current chunk
        left, skip = self.encode(text, 0, min(len(text), self.chunk + self.overlap)), 0
        while left[2] < len(text):
            overlap = self.overlap
            while True:
                start = max(left[1], left[2] - overlap)
                right = self.encode(text, start, min(len(text), left[2] + self.chunk))
                at = self.splice(text, left, right, skip)
                if at or start == left[1]:
                    break
                overlap *= 2
            if at:
                done += at[0] - skip
                left, skip = right, at[1]
            else:  # the overlap is the whole chunk and still nothing agrees: one longer chunk instead of two
                left, skip = self.encode(text, left[1], right[2]), skip
        return done + len(left[0]) - skip

    def splice(self, text: str, left, right, skip: int) -> tuple[int, int] | None:
        """The numbers of tokens, left and right, before a token that both have; None if there is none."""
        (a, _, end), (b, start, _) = left, right
        low, high = start + self.margin * (start > 0), end - self.margin
        i = max(skip, bisect_left(a, (low, 0, 0)))
        known = {t: k for k, t in enumerate(b[: bisect_left(b, (high, 0, 0))]) if t[0] >= low}
        best = None
        for k in range(i, len(a)):
            s, e, _ = t = a[k]
            if e > high:
                break
            if t in known and e > s and not unicodedata.combining(text[s]):
                if k + 1 < len(a) and a[k - 1][:2] == t[:2] or a[k + 1 : k + 2] and a[k + 1][:2] == t[:2]:
                    continue  # several tokens of one character
                if s and text[s - 1] in " \n":
                    return k, known[t]
                best = best or (k, known[t])
        return best


@lru_cache(maxsize=4)
def counter(name: str) -> ChunkCounter:
    """One for each Python worker."""
    return ChunkCounter(vocabulary_path(name))


COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def count_tokens(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every whole text. A null text counts as empty: 0
    bytes, 0 tokens. Repeated rows and null doc_ids keep their rows; other columns are left out; no rows give no rows."""
    ship(spark)

    def run(batches):
        counts = counter(vocabulary)
        for batch in slices(batches):
            texts = texts_of(batch.column("text"))
            n = [counts.count(x.decode()) for x in texts]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(map(len, texts), pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                ],
                schema=COUNTS,
            )

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return count_tokens(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
