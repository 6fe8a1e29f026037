"""Operator 4: best-fit-decreasing packing of documents into token sequences.

A document's ids (byte-level BPE, then id 0) are first cut into full windows of ``capacity`` tokens;
what is left over is packed by best-fit decreasing: a segment tree indexed by remaining capacity
finds the tightest open window that takes a piece. Pieces are dealt by hash into groups of about
``group_docs`` documents that are packed independently, so nothing global is sorted or collected and
the padding lost to grouping is at most a few windows a group.

Tokenising is the cost here. The vocabulary's merges are a byte-pair encoding by rank, so its ids are
computed by a faster encoder of the same ranks and pre-tokeniser pattern; texts that hold a special token's string or a run
of over ``RUN`` characters without a space go to the tokeniser itself. Very long texts are encoded in stretches cut
before single spaces, where no pre-token crosses.

Defined cases: null text is empty and has the one id 0; a document whose ids fill windows exactly has
no left-over piece; repeated rows are packed each; very long texts are cut like any others; ties in length go by
doc_id, then start, then checksum; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.llm.arrow import documents, map_batches, map_sorted_groups, texts

CAPACITY = 1024
RUN, STRETCH = 100_000, 1 << 20


class Ids:
    """The ids of whole texts, as little-endian unsigned 32-bit bytes, by the byte-level BPE tokenizer at ``path``."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path, self.special = path, [t["content"] for t in spec["added_tokens"]]
        letters = {letter: byte for byte, letter in byte_letters().items()}
        vocab = {word: k for word, k in spec["model"]["vocab"].items() if word not in self.special}
        made = [vocab["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in spec["model"]["merges"]]
        # merging by order of the list is merging by rank only if ids rise along the list
        self.ranked = all(a < b for a, b in zip(made, made[1:]))
        ranks = {bytes(letters[c] for c in word): k for word, k in vocab.items()}
        self.fast = tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.gap = regex.compile(r"(?<=\S) (?=\S)")

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def plain(self, text: str) -> bool:
        """Whether the fast encoder gives the tokenizer's ids in good time."""
        return self.ranked and not any(s in text for s in self.special) and (len(text) <= RUN or longest_run(text) <= RUN)

    def of(self, text: str) -> bytes:
        if not self.plain(text):
            return raw(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(text) <= STRETCH:
            return raw(self.fast.encode_ordinary(text))
        out, at = bytearray(), 0
        while at < len(text):
            found = self.gap.search(text, at + STRETCH)
            end = found.start() if found else len(text)
            out += raw(self.fast.encode_ordinary(text[at:end]))
            at = end
        return bytes(out)


def longest_run(text: str) -> int:
    """The most characters between two spaces."""
    return max(map(len, text.split(" ")))


def byte_letters() -> dict[int, str]:
    """Byte -> its letter in the byte-level alphabet: printable ones stand for themselves, the others
    follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(other)}


def raw(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


@lru_cache(maxsize=1)
def ids_of(path: str) -> Ids:
    return Ids(path)


class TightestFit:
    """A segment tree over remaining capacities 0..capacity; a leaf holds the open windows with it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, window) -> None:
        self.open[room].append(window)
        node = self.size + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int):
        """The window with the least room of at least ``least``, as (room, window), or None."""
        node, count = self.size + least, self.count
        while not count[node]:
            # climb to the next subtree on the right
            while node & 1:
                node >>= 1
                if node <= 1:
                    return None
            if node <= 1:
                return None
            node += 1
        while node < self.size:
            node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(window, offset) of each piece; ``lengths`` must fall. Windows are numbered from 0 as opened."""
    tree, windows, at, opened = TightestFit(capacity), [], [], 0
    for length in lengths:
        found = tree.take(length) if length < capacity else None
        if found is None:
            room, window = capacity, opened
            opened += 1
        else:
            room, window = found
        windows.append(window)
        at.append(capacity - room)
        if room > length:
            tree.put(room - length, window)
    return windows, at


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): every document cut into full windows and a rest."""
    import public_tokenizers

    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    end = raw([0])
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids

    def make(batch: pa.RecordBatch) -> dict:
        values = [t.decode("utf-8", "replace") for t in texts(batch)]
        names = batch.column("doc_id").to_pylist()
        out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
        step = 4 * capacity
        encode = ids_of(path).of
        for name, text in zip(names, values):
            ids = encode(text) + end
            for a in range(0, len(ids), step):
                part = ids[a : a + step]
                out["doc_id"].append(name)
                out["start"].append(a // 4)
                out["length"].append(len(part) // 4)
                out["ids_crc32"].append(zlib.crc32(part))
                out["doc_tokens"].append(len(ids) // 4)
                if with_ids:
                    out["ids"].append(part)
        return out

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), make, schema)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, group_docs: int = 4096, with_ids: bool = False) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; with ``with_ids`` their ids as little-endian uint32 bytes."""
    groups = max(1, -(-docs.count() // group_docs))
    cut_up = pieces(docs, tokenizer_path, capacity, with_ids)
    dealt = cut_up.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "doc_tokens", "ids_crc32"), F.lit(groups)))
    ordered = dealt.repartition("part").sortWithinPartitions("part", F.desc("length"), "doc_id", "start", "ids_crc32")
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids

    def make(table: pa.Table) -> dict:
        part, length = table["part"].to_numpy(), table["length"].to_numpy()
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        sequence, offset = [], []
        for a, b in zip(edges, edges[1:]):
            windows, at = best_fit_decreasing(length[a:b].tolist(), capacity)
            sequence += [(int(part[a]) << 32) + w for w in windows]
            offset += at
        return {n: table[n] for n in table.column_names if n != "part"} | {"sequence_id": sequence, "offset": offset}

    return map_sorted_groups(ordered, ["part"], make, schema, most_rows=20_000)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
