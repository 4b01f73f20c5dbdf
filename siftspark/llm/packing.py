"""Token ids, packed by best-fit decreasing.

Texts become token ids and end with END_ID. A document over the row length is split into parts of that length,
losslessly; parts go, longest first, each into the fullest row that still has room. Rows are found by a segment
tree over their room left: a leaf counts the rows with exactly that room, an inner node the rows below it, and the
search for the least room that suffices goes up and down the tree once. A packed row has its ids and the positions,
which start again at 0 with each part, as little-endian binary, the cumulative lengths of its parts, and which part
of which document each is. What is left of a row is filled with PAD_ID and position 0, beyond the last length.

Parts are packed with those read in the same task, GROUP_TOKENS at a time: nothing is shuffled, memory is bounded,
and each group leaves a few rows unfilled at most. A lost task packs the same rows again.

Defined results: null and empty texts are their end alone; null ids are allowed; rows that repeat are packed each;
an empty table gives an empty result; further columns are not read; runs of white space of any length get the ids
that the tokenizer's rule gives them, past the splitter's limit as well.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the rank file's merges expect text to be split; fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 50256
PAD_ID = 50256
ROW = 2048
GROUP_TOKENS = 4_000_000
#: Runs of white space from here on bypass the splitter, whose stack ends at about a million.
SPACES = 50_000
#: White space as the splitter knows it; fixed value.
_WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


class Fullest:
    """Segment tree over room left (0 .. row): finds the least room >= n that some row has."""

    def __init__(self, row: int) -> None:
        self.leaves = 1 << row.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """(room, row) with the least room of at least n, taken out; None if no row has as much."""
        node = n + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, self.rows[room].pop()


def pack(lengths: list[int], row: int) -> list[list[int]]:
    """Rows of part numbers: best fit, longest first."""
    rows: list[list[int]] = []
    tree = Fullest(row)
    for part in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if (found := tree.take(lengths[part])) is None:
            found = (row, len(rows))
            rows.append([])
        rows[found[1]].append(part)
        tree.put(found[0] - lengths[part], found[1])
    return rows


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, split: str = SPLIT) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=table, special_tokens={})


def encode(encoding: tiktoken.Encoding, whole: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of any text; special tokens' names are ordinary text. whole: the same ranks without a splitter.

    By the splitter's rule a run of white space is one piece, but for its last character where more text follows.
    """
    if len(text) <= SPACES:
        return encoding.encode_ordinary(text)
    out, at = [], 0
    for run in re.finditer(f"{_WHITE}{{{SPACES},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += encoding.encode_ordinary(text[at : run.start()])
        out += whole.encode_ordinary(text[run.start() : end])
        at = end
    return out + encoding.encode_ordinary(text[at:])


SCHEMA = "part int, number int, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, pieces array<int>"


def packed(docs: DataFrame, row: int = ROW, ranks_path: str = RANKS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Packed rows. (part, number) tells them apart; ids and positions have `row` unsigned 16-bit values each (32-bit if either needs it)."""
    with open(ranks_path, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    wide = row > 65_535
    kind = "<u4" if wide else "<u2"

    def build(parts: list[tuple[int | None, int, np.ndarray]], first: int) -> pa.RecordBatch:
        out: dict[str, list] = {name.split()[0]: [] for name in SCHEMA.split(", ")}
        count = np.arange(row, dtype=kind)
        for number, members in enumerate(pack([len(p[2]) for p in parts], row)):
            own = [parts[i] for i in members]
            sizes = [len(p[2]) for p in own]
            used = sum(sizes)
            ids, positions = np.full(row, PAD_ID, kind), np.zeros(row, kind)
            ids[:used] = np.concatenate([p[2] for p in own])
            positions[:used] = np.concatenate([count[:n] for n in sizes])
            for name, value in zip(out, (TaskContext.get().partitionId(), first + number, used, ids.tobytes(), positions.tobytes(), [0, *np.cumsum(sizes).tolist()], [p[0] for p in own], [p[1] for p in own])):
                out[name].append(value)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, whole = _encoding(ranks.value), _encoding(ranks.value, r"[\s\S]+")
        parts, held, first = [], 0, 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.array([*encode(encoding, whole, text.as_py() or ""), END_ID], kind)
                parts += [(doc, i // row, ids[i : i + row]) for i in range(0, len(ids), row)]
                held += len(ids)
                if held >= group_tokens:
                    yield (made := build(parts, first))
                    parts, held, first = [], 0, first + made.num_rows
        if parts:
            yield build(parts, first)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the packed rows, one binary id row and position row each, for a loader to map into matrices."""
    packed(docs, **options).write.parquet(path)


def op4_token_packing(docs: DataFrame) -> DataFrame:
    """All documents as packed rows."""
    return packed(docs)
