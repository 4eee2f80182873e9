"""Byte-level BPE encoding and decoding by tree concatenation.

A text is cut into pre-tokens. A pre-token that is long (unsplit text: one word of many kilobytes, a long run of blanks) is
halved until its parts are small, the parts are encoded in parallel, and neighbours are joined bottom up: the tokens next to
a join are encoded again as one string, in a window that grows until its outermost tokens are those that both sides had.

Why that is exact: a token sequence is the encoding of its text if and only if each two neighbouring tokens are the encoding
of their joint text. All pairs inside the window come from an encoding of the window, all pairs outside from an encoding of
a side, and the pairs that straddle the window's edge are pairs that the side already had, because the outermost tokens of
the window are the same.
"""

from __future__ import annotations

import json
import os
import re
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from perilgrid.llm.runtime import ship, slices, texts_of

VOCABULARY = "byte_bpe_50k.json"
LEAF = 256  # bytes of a leaf of the tree
WINDOW = 8  # tokens on each side of a join, at first


def vocabulary_path(name: str) -> str:
    """A path stays as it is; a bare name is one of the public tokenizers' files."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones as themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TreeEncoder:
    """Encodes as the tokenizers library does with the same file."""

    #: Characters for which the pre-tokenizers of both libraries are known to agree; other texts are cut by tokenizers' own.
    common = re.compile("[^\x00-ԯ‐-‧‰-⁞€]")

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW, threads: int = 2):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.leaf, self.window, self.threads = leaf, window, threads
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        pairs = (x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"])
        order = [ranks[bytes(letters[c] for c in a + b)] for a, b in pairs]
        if order != sorted(order):
            raise ValueError("ids must follow the order of merges")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        self.name_of = {i: str(i).encode() for i in self.bytes_of}
        self.core = tiktoken.Encoding("tree", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.long = re.compile(rf"\S{{{leaf},}}|\s{{{leaf},}}")
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def encode(self, text: str) -> list[int]:
        if not self.long.search(text) and not self.common.search(text):
            return self.core.encode(text, allowed_special="all")
        ids: list[int] = []
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            self._pieces(text[at : m.start()], ids)
            ids.append(self.special[m[0]])
            at = m.end()
        self._pieces(text[at:], ids)
        return ids

    def _pieces(self, text: str, ids: list[int]) -> None:
        if text:
            for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text):
                ids += self.piece(text[a:b].encode())

    def piece(self, data: bytes) -> list[int]:
        """Encodes one pre-token."""
        if len(data) <= self.leaf:
            return self._whole(data)
        parts = [data[i : i + self.leaf] for i in range(0, len(data), self.leaf)]
        if len(parts) >= 64:
            with ThreadPoolExecutor(self.threads) as pool:
                level = list(pool.map(self._whole, parts, chunksize=32))
        else:
            level = [self._whole(x) for x in parts]
        while len(level) > 1:
            joined = [self.join(a, b) for a, b in zip(level[::2], level[1::2], strict=False)]
            level = joined + level[len(joined) * 2 :]
        return level[0]

    def _whole(self, data: bytes) -> list[int]:
        return self.core._encode_single_piece(data)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encodings' joint text."""
        k = self.window
        while True:
            tail, head = left[-k:], right[:k]
            between = self._whole(b"".join(self.bytes_of[i] for i in (*tail, *head)))
            if (len(tail) == len(left) or between[0] == tail[0]) and (len(head) == len(right) or between[-1] == head[-1]):
                return left[: len(left) - len(tail)] + between + right[len(head) :]
            k *= 2

    def decode(self, ids: list[int]) -> str:
        """As the library's decode with special tokens kept."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(name: str) -> TreeEncoder:
    """One for each Python worker."""
    return TreeEncoder(vocabulary_path(name))


DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def encode_texts(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text. A null text counts as empty and has no ids; repeated rows and null
    doc_ids keep their rows; other columns are left out; no rows give no rows."""
    ship(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        tree = encoder(vocabulary)
        for batch in slices(batches):
            ids = [tree.encode(x or "") for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(spark: SparkSession, encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    ship(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        tree = encoder(vocabulary)
        for batch in batches:
            texts = [tree.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest_texts(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Encodes and decodes every whole text in one pass and keeps digests: doc_id, n_tokens, ids_sha256 (decimal ids joined
    by commas), decoded_sha256. Nulls, repeats, extra columns and empty tables as in ``encode_texts``."""
    ship(spark)

    def run(batches):
        tree = encoder(vocabulary)
        for batch in slices(batches):
            n, ids_sha, text_sha = [], [], []
            for data in texts_of(batch.column("text")):
                ids = tree.encode(data.decode())
                n.append(len(ids))
                ids_sha.append(sha256(b",".join(map(tree.name_of.__getitem__, ids))).hexdigest())
                text_sha.append(sha256(tree.decode(ids).encode()).hexdigest())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                schema=DIGEST,
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, schema)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's encoding and decoding."""
    return digest_texts(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
