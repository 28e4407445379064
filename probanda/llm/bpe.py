"""Byte-level BPE encoding and decoding with a given vocabulary.

Each word of the splitting pattern is encoded by a contiguous rank array: part boundaries
and the ranks of adjacent parts lie in two flat lists; the smallest rank is found by a scan,
its boundary deleted and the two neighbouring ranks refreshed.  Words over LONG_WORD bytes
take the same merges in the same order from a heap, as repeated scans are quadratic.

Cases: null and empty texts have no tokens; the string of a special token is that token;
repeated rows are encoded alike; an empty table gives an empty table; columns named like
the outputs are replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ship, with_columns, without

LONG_WORD = 256  # bytes; beyond, the heap
CACHE_WORDS = 300_000  # words of each of the two generations a task process remembers
CACHED_BYTES = 48
NONE = 1 << 29  # above every rank

# The splitting pattern of the byte-level vocabularies, and the code points
# that became letters or numbers after Unicode 16, which the vocabulary's library follows.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\s]+|\s+(?!\S)|\s+"
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"  # of Latin-1
NEWER = (
    r"՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱"
    r"꭬-꭭\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
    r"\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f"
    r"\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2"
    r"\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed"
    r"\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    r"\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


def pattern(newer: bool) -> regex.Pattern:
    """The splitting pattern; ``newer``: with the late letters and numbers as neither."""
    if not newer:
        return regex.compile(SPLIT.replace("L+", r"\p{L}+").replace("N+", r"\p{N}+").replace(r"[^\s]", r"[^\s\p{L}\p{N}]"))
    letter, number = rf"[\p{{L}}--[{NEWER}]]+", rf"[\p{{N}}--[{NEWER}]]+"
    other = rf"[[^\s\p{{L}}\p{{N}}]||[{NEWER}]]"
    return regex.compile(SPLIT.replace("L+", letter).replace("N+", number).replace(r"[^\s]", other), regex.V1)


def byte_letters() -> dict[int, str]:
    """The letter a byte-level vocabulary writes for each byte: printable Latin-1 stands
    for itself, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Merges, pieces and special tokens of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        ids, letters = data["model"]["vocab"], byte_letters()
        back = {letter: b for b, letter in letters.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.single = [ids[letters[b]] for b in range(256)]
        pieces = {i: bytes(back[c] for c in s) for s, i in ids.items()}
        pieces |= {i: s.encode() for s, i in self.special.items()}
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.merges, self.made = {}, []  # pair of ids → rank; rank → id of the merged piece
        for rank, (a, b) in enumerate(data["model"]["merges"]):
            self.merges[ids[a] << 20 | ids[b]] = rank
            self.made.append(ids[a + b])
        at = self.single
        self.first = [[self.merges.get(at[x] << 20 | at[y], NONE) for y in range(256)] for x in range(256)]


class Encoder(dict):
    """Word → token ids.  Remembers short words: when full, the memory becomes the old
    generation, from which words still in use come back."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v, self.old = vocabulary, {}
        self.plain, self.late = pattern(False), pattern(True)
        self.latin = re.compile(SPLIT.replace("L+", f"[{LETTERS}]+").replace("N+", f"[{NUMBERS}]+").replace(r"[^\s]", f"[^{SPACES}{LETTERS}{NUMBERS}]").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]"))
        self.beyond = re.compile("[\u0100-\U0010ffff]")
        self.newer = regex.compile(f"[{NEWER}]")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word)
        if ids is None:
            data = word.encode()
            ids = tuple(self.scan(data) if len(data) <= LONG_WORD else self.heap(data))
            if len(data) > CACHED_BYTES:
                return ids
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def scan(self, data: bytes) -> list[int]:
        merges, single = self.v.merges, self.v.single
        part = [single[b] for b in data]  # one id per part, in order of its boundary
        first = self.v.first
        rank = [first[a][b] for a, b in zip(data, data[1:])]
        while rank and (least := min(rank)) != NONE:
            i = rank.index(least)
            part[i] = self.v.made[least]
            del part[i + 1], rank[i]
            if i < len(rank):
                rank[i] = merges.get(part[i] << 20 | part[i + 1], NONE)
            if i:
                rank[i - 1] = merges.get(part[i - 1] << 20 | part[i], NONE)
        return part

    def heap(self, data: bytes) -> list[int]:
        merges = self.v.merges
        part = [self.v.single[b] for b in data]
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m, i) for i in range(n - 1) if (m := merges.get(part[i] << 20 | part[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            m, i = heapq.heappop(queue)
            j = after[i]
            if part[i] < 0 or j >= n or merges.get(part[i] << 20 | part[j]) != m:
                continue
            part[i], part[j] = self.v.made[m], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := merges.get(part[i] << 20 | part[k])) is not None:
                    heapq.heappush(queue, (m, i))
            if (h := before[i]) >= 0 and (m := merges.get(part[h] << 20 | part[i])) is not None:
                heapq.heappush(queue, (m, h))
        return [p for p in part if p >= 0]

    def words(self, text: str) -> list[str]:
        if not self.beyond.search(text):  # the same classes, by the quicker library
            return self.latin.findall(text)
        return (self.late if self.newer.search(text) else self.plain).findall(text)

    def encode_into(self, text: str, out: array) -> None:
        segments = self.cut.split(text) if self.cut and any(s in text for s in self.v.special) else [text]
        for segment in segments:
            if segment in self.v.special:
                out.append(self.v.special[segment])
            elif segment:
                out.extend(chain.from_iterable(map(self.__getitem__, self.words(segment))))


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` array<int>.  The vocabulary file is read once, here; its size is fixed,
    and it travels as a broadcast, whose word memory lasts from task to task."""
    shared = ship(docs).sparkSession.sparkContext.broadcast(Encoder(Vocabulary(path)))

    def run(texts: list[str]) -> list[pa.Array]:
        encoder = shared.value
        values, ends = array("i"), [0]
        for t in texts:
            encoder.encode_into(t, values)
            ends.append(len(values))
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(values, np.int32) if values else [], pa.int32()))]

    return with_columns(docs, T.StructType().add("ids", T.ArrayType(T.IntegerType())), text, run, keep)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` string from the column ``ids``; malformed bytes become U+FFFD."""
    shared = ship(encoded).sparkSession.sparkContext.broadcast(Vocabulary(path).pieces)
    encoded = without(encoded, "decoded")
    schema = T.StructType([*encoded.schema, T.StructField("decoded", T.StringType())])

    def task(batches):
        piece = shared.value.__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                column = part.column(part.schema.get_field_index(ids))
                values = column.flatten().to_numpy(zero_copy_only=False).tolist()
                texts, at = [], 0
                for n in column.value_lengths().to_pylist():
                    texts.append(b"".join(map(piece, values[at : at + (n or 0)])).decode("utf-8", "replace"))
                    at += n or 0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], schema.names)

    return encoded.mapInArrow(task, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: token count, and digests of the ids and of the decoded text."""
    both = decode(encode(docs.select("doc_id", "text"), path, keep=["doc_id"]), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
