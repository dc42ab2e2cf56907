"""Order-preserving packing of documents into fixed windows by dynamic programming.

Each input partition is a stream of tokens in its row order. Possible cuts are document ends (free), sentence
ends (a penalty for the cut text) and, only in stretches of more than ``STRIDE`` tokens without either, every
``STRIDE`` tokens (a larger penalty). The cost of a sequence is its padding plus the penalty of the cut that ends it;
the cheapest chain of cuts with at most ``window`` tokens between neighbours is found with a monotone queue, in time
linear in the cuts. The stream goes block by block: the last sequence of a block is carried into the next one, so
memory does not follow the partition's size. A partition's last sequence is padded like any other.

Null or empty text is a document of one token (the end id); a null doc_id is kept as it is; repeated rows are packed as
often as they occur; an empty table gives no rows; other columns are not read. Cuts and sequence ids follow the input
partitions: the same table split otherwise is packed otherwise, each packing whole and in order. Sequence ids are the
partition's number in the upper bits and a counter in the lower.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.common import bound_batches, tidy
from lodestone.llm.merging import PairTable, merge_words

WINDOW, END_ID = 2048, 1
#: What a cut costs, in tokens of padding: at a sentence end, and at neither document nor sentence end.
SENTENCE_PENALTY, STRIDE, STRIDE_PENALTY = 16, 128, 64
#: Tokens that are planned at once.
BLOCK = 1 << 19
#: Words and ids that a worker remembers before it starts anew.
REMEMBERED, REMEMBERED_IDS = 200_000, 1 << 21
#: The letters, digits and white space among the Latin-1 characters.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
#: The vocabulary's matches in lower-case Latin-1 words, and the line ends between these.
LATIN = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
#: Words that only the library reads: with characters beyond Latin-1, or with what starts a special token's string.
LIBRARY_ONLY = r"[^\x{00}-\x{ff}]|<\|"
WORD_END = "</w>"
STOPS = (".", "!", "?", "...", '."', '!"', '?"', ".)")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next code point from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in keep else next(spare)) for b in range(256)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + lengths[i] - 1 of every i, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Rows:
    """Rows of 32-bit ids by key, in growing arrays."""

    def __init__(self) -> None:
        self.row: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.size = 0

    def add(self, keys: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Rows of new keys, their ids concatenated."""
        n, size = len(self.row), self.size + len(ids)
        if n + len(keys) > len(self.starts):
            more = 2 * (n + len(keys))
            self.starts, self.lengths = np.resize(self.starts, more), np.resize(self.lengths, more)
        if size > len(self.ids):
            self.ids = np.resize(self.ids, 2 * size)
        self.row.update(zip(keys, range(n, n + len(keys))))
        self.lengths[n : n + len(keys)] = lengths
        self.starts[n : n + len(keys)] = self.size + np.cumsum(lengths) - lengths
        self.ids[self.size : size] = ids
        self.size = size

    def places(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.row.__getitem__, keys), np.int64, len(keys))

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows at ``places``, concatenated, and each row's number of ids."""
        lengths = self.lengths[places]
        return self.ids[ragged(self.starts[places], lengths)], lengths


class WordTokenizer:
    """Ids of the word-level BPE vocabulary: the library for any word, lockstep merges for Latin-1 words."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.table = PairTable(
            np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]), np.arange(len(pairs)), np.array([vocab[a + b] for a, b in pairs])
        )
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + WORD_END] for c in letters], np.int64)
        stops = [s + WORD_END for s in STOPS]
        self.stops = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.stops[[vocab[s] for s in stops if s in vocab]] = True
        self.forget()

    def forget(self) -> None:
        self.words, self.matches = Rows(), Rows()

    def merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all matches, concatenated, and each one's number of ids; a line end has none."""
        raw = [b"" if p == "\n" else p.encode() for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        last = (np.cumsum(lengths) - 1)[lengths > 0]
        symbols[last] = self.final[data[last]]
        flat, n = merge_words(symbols, lengths, self.table)
        return flat.astype(np.uint32), n

    def learn(self, words: list[str]) -> None:
        """Remember the ids of new words."""
        odd = pc.match_substring_regex(pa.array(words, pa.string()), LIBRARY_ONLY).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd).tolist():
            ids = np.array(self.library.encode(words[i], add_special_tokens=False).ids, np.uint32)
            self.words.add([words[i]], ids, np.array([len(ids)]))
        latin = [w for w, o in zip(words, odd.tolist()) if not o]
        if not latin:
            return
        found = LATIN.findall("\n".join(latin).lower() + "\n")
        distinct = [m for m in dict.fromkeys(found) if m not in self.matches.row]
        if distinct:
            self.matches.add(distinct, *self.merge(distinct))
        places = self.matches.places(found)
        ids, lengths = self.matches.take(places)
        ends = np.flatnonzero(places == self.matches.row["\n"])
        totals = np.cumsum(lengths)[ends]
        self.words.add(latin, ids, np.diff(totals, prepend=0))

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, concatenated, and each text's number of ids.

        White space bounds every match, so words are encoded apart and remembered.
        """
        if len(self.words.row) > REMEMBERED or self.words.size + self.matches.size > REMEMBERED_IDS:
            self.forget()
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self.learn([w for w in distinct if w not in self.words.row])
        words = np.diff(split.offsets.to_numpy())
        ids, lengths = self.words.take(self.words.places(distinct)[coded.indices.to_numpy()])
        run = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(words)
        return ids, run[ends] - run[ends - words]


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def cheapest_cuts(places: list[int], penalties: list[int], window: int) -> list[int]:
    """The cuts (positions) of the cheapest chain over ``places``; the first and last place are always in it.

    Neighbouring places are at most ``window`` apart. f(j) = penalty(j) + window - place(j) + min over places i
    within the window of f(i) + place(i); the queue holds the i that can still be a minimum, best first. The last
    sequence is carried on or ends the stream, so its padding is not counted.
    """
    cost = [0] * len(places)
    before = [0] * len(places)
    queue: deque[tuple[int, int]] = deque([(places[0], 0)])
    for j in range(1, len(places)):
        at = places[j]
        while places[queue[0][1]] < at - window:
            queue.popleft()
        value, i = queue[0]
        before[j] = i
        cost[j] = value + window - at + penalties[j]
        mine = cost[j] + at
        while queue and queue[-1][0] >= mine:
            queue.pop()
        queue.append((mine, j))
    j = len(places) - 1
    open_end = range(bisect_left(places, places[j] - window), j)
    before[j] = min(open_end, key=cost.__getitem__, default=0)
    cuts = []
    while j:
        cuts.append(places[j])
        j = before[j]
    return cuts[::-1]


def cut_places(tokens: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut, and what each cut costs."""
    price = np.full(len(tokens) + 1, -1, np.int64)
    price[1:][stops[tokens]] = SENTENCE_PENALTY
    price[ends] = 0
    price[0] = 0
    natural = np.flatnonzero(price >= 0)
    steps = (np.diff(natural) - 1) // STRIDE
    inner = natural[:-1].repeat(steps) + STRIDE * (1 + ragged(np.zeros(len(steps), np.int64), steps))
    price[inner] = STRIDE_PENALTY
    places = np.flatnonzero(price >= 0)
    return places, price[places]


@dataclass
class Fragment:
    doc_id: int | None
    start: int  # tokens of the document before it
    doc_tokens: int
    ids: np.ndarray


class Packer:
    """Packs one stream; ``add`` documents, take finished pieces."""

    COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def __init__(self, stream: int, stops: np.ndarray, window: int = WINDOW):
        self.next_id, self.stops, self.window = stream << 32, stops, window
        self.held: list[Fragment] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        self.held.append(Fragment(doc_id, 0, len(ids), ids))
        self.size += len(ids)
        return self.flush(False) if self.size >= BLOCK else []

    def flush(self, last: bool) -> list[tuple]:
        if not self.held:
            return []
        tokens = np.concatenate([f.ids for f in self.held])
        ends = np.cumsum([len(f.ids) for f in self.held])
        total = int(ends[-1])
        places, price = cut_places(tokens, ends, self.stops)
        cuts = cheapest_cuts(places.tolist(), price.tolist(), self.window)
        if not last:
            cuts = cuts[:-1]
        until = cuts[-1] if cuts else 0
        pieces = []
        if until:
            bounds = np.unique(np.concatenate([[0], cuts, ends[ends < until]]))
            doc = np.searchsorted(ends, bounds[:-1], side="right")
            seq = np.searchsorted(cuts, bounds[:-1], side="right")
            seq_start = np.concatenate([[0], cuts])[seq]
            doc_start = np.concatenate([[0], ends])[doc]
            raw = tokens.astype("<u4")
            for a, b, d, s, s0, d0 in zip(bounds[:-1].tolist(), bounds[1:].tolist(), doc.tolist(), seq.tolist(), seq_start.tolist(), doc_start.tolist()):
                f = self.held[d]
                pieces.append((f.doc_id, f.start + a - d0, b - a, zlib.crc32(raw[a:b].data), f.doc_tokens, self.next_id + s, a - s0))
            self.next_id += len(cuts)
        keep = int(np.searchsorted(ends, until, side="right"))
        rest = self.held[keep:]
        if rest and (gone := until - int(ends[keep] - len(rest[0].ids))):
            rest[0] = Fragment(rest[0].doc_id, rest[0].start + gone, rest[0].doc_tokens, rest[0].ids[gone:])
        self.held, self.size = rest, sum(len(f.ids) for f in rest)
        return pieces


def pack_documents(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    bound_batches(docs.sparkSession)

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        columns = zip(*pieces) if pieces else [[]] * len(Packer.COLUMNS)
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=list(Packer.COLUMNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(vocabulary or public_tokenizers.path("word_bpe_49k.json"))
        packer = Packer(TaskContext.get().partitionId(), words.stops, window)
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            tokens, lengths = words.encode_texts(pc.fill_null(batch.column("text"), ""))
            pieces: list[tuple] = []
            start = 0
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), lengths.tolist()):
                pieces += packer.add(doc_id, np.concatenate([tokens[start : start + n], end]))
                start += n
            yield rows(pieces)
        yield rows(packer.flush(True))
        tidy()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, schema)
