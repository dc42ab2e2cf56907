"""Byte-level BPE encoding and decoding by ranked merges on a segment tree.

A text is cut by the vocabulary's pattern; each match is merged on its own (``merging``). Words that a worker has
met keep their ids in a bounded table, so the merges run once per distinct word and batch. Texts of Latin-1
characters are cut at blanks first (a blank starts a match and never ends one unless white space follows), which
gives the same matches; all others go through the full Unicode pattern.

Null text encodes like the empty text (no ids); a null doc_id is returned as it is; rows are independent, so repeated
rows, ties and other columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_batches, spread
from lodestone.llm.merging import PairTable, merge_words

#: Distinct words a worker remembers before it starts anew.
REMEMBERED = 400_000
#: The letters, digits and white space among the Latin-1 characters.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
SPACE_THEN_BLANK = re.compile(rf"[{SPACES}] ")


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        self.pattern = regex.compile(pattern)
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = {r: t for t, r in self.ranks.items()}
        found = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, rank = (np.array(x, np.int64) for x in zip(*found))
        self.table = PairTable(left, right, rank, np.arange(max(self.ranks.values()) + 1))
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.forget()

    def forget(self) -> None:
        self.after_blank: dict[str, tuple[str, bytes]] = {}

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        out: list[list[int] | None] = [[self.ranks[p]] if p in self.ranks else None for p in pieces]
        todo = [i for i, ids in enumerate(out) if ids is None]
        if todo:
            lengths = np.array([len(pieces[i]) for i in todo], np.int64)
            symbols = self.first[np.frombuffer(b"".join(pieces[i] for i in todo), np.uint8)]
            flat, n = merge_words(symbols, lengths, self.table)
            flat, ends = flat.tolist(), np.cumsum(n).tolist()
            start = 0
            for i, end in zip(todo, ends):
                out[i], start = flat[start:end], end
        return out  # type: ignore[return-value]

    def encode_each(self, pieces_of: list[list[str]]) -> list[list[int]]:
        """Ids of each list of matches; each distinct match is merged once."""
        distinct = list({p for pieces in pieces_of for p in pieces})
        ids = dict(zip(distinct, self.merge([p.encode("utf-8", "surrogatepass") for p in distinct])))
        return [[i for p in pieces for i in ids[p]] for pieces in pieces_of]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        return self.encode_each([self.pattern.findall(text)])[0]

    def encode_texts(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """For each text its decimal ids joined by blanks, and the bytes these decode to."""
        known = self.after_blank
        plans: list[tuple[list[str], list[str]]] = []  # matches, then words that each follow a blank
        missing: set[str] = set()
        for text in texts:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                plans.append((self.pattern.findall(text), []))
                continue
            if SPACE_THEN_BLANK.search(text) or text.endswith(" "):
                plans.append((LATIN.findall(text), []))
                continue
            head, *words = text.split(" ")
            plans.append((LATIN.findall(head), words))
            missing.update(w for w in words if w not in known)
        order = list(missing)
        encoded = self.encode_each([LATIN.findall(f" {w}") for w in order] + [p for p, _ in plans])
        for w, ids in zip(order, encoded):
            known[w] = (" ".join(map(str, ids)), self.decode(ids))
        out = []
        for (_, words), ids in zip(plans, encoded[len(order) :]):
            parts = [(" ".join(map(str, ids)), self.decode(ids))] if ids else []
            parts += map(known.__getitem__, words)
            out.append((" ".join([p[0] for p in parts]), b"".join([p[1] for p in parts])))
        if len(known) > REMEMBERED:
            self.forget()
        return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode_documents(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row. ``vocabulary`` is a file each worker can open."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
        bpe = codec(path, pattern or public_tokenizers.PATTERN)
        counts, ids_sha, bytes_sha = [], [], []
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for at in range(0, len(texts), 200):
            for ids, data in bpe.encode_texts(texts[at : at + 200]):
                counts.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                bytes_sha.append(hashlib.sha256(data).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(spread(source), one, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
