"""Cost-balanced packing of tokenised documents into fixed sequences.

A piece of n tokens costs linear * n + quadratic * n * n, what a layer pays for its projections and for attention
within the piece. Whole capacities are cut off long documents first; the rests, in descending order, each go to the
sequence of least cost that has room. A rest that fits nowhere is cut: the roomiest sequence takes what it can hold,
and what is left is placed in its turn. Sequences are as many as the tokens fill, and what remains of a block fills
shorter ones, each a power of two, so nothing is padded, however the input is partitioned.

Packing works on blocks of documents inside a task, in the order in which they are read, and needs no shuffle; a
block is bounded in tokens, whatever one document brings. The same input files give the same sequences.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import freed, table

CAPACITY = 1024
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens after which a block is packed.
BLOCK = 2_000_000
END = 0
#: A run of blanks of this length is left to the slower encoder; the fast one's regex would run out of stack.
BLANKS = 20_000

_encoders: dict = {}


def encoder(vocabulary: str):
    """text -> ids under a byte-level BPE file, as tokenizers gives them without adding special tokens.

    tokenizers itself takes texts that hold one of the file's special strings, which it knows inside a text too, and
    long blank runs; a byte-pair encoder over the same vocabulary, whose ids are the merge ranks, gives the same ids
    for all else in a quarter of the time (tests compare the two).
    """
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            held = json.load(f)
        special = {t["content"] for t in held["added_tokens"]}
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte[c] for c in t): i for t, i in held["model"]["vocab"].items() if t not in special}
        fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        blanks, apart = re.compile(rf"\s{{{BLANKS}}}"), re.compile("|".join(map(re.escape, sorted(special))) or r"(?!)")

        def encode(text: str) -> list[int]:
            if apart.search(text) or (len(text) >= BLANKS and blanks.search(text)):
                return own.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _encoders[vocabulary] = encode
    return _encoders[vocabulary]


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def sequence_sizes(total: int, capacity: int) -> list[int]:
    """Sizes of the sequences that these tokens fill: whole capacities, then powers of two for the remainder."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(lengths: list[int], capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of each piece; lengths are below capacity and above 0."""
    sizes = sequence_sizes(sum(lengths), capacity)
    rooms: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]  # by room left: sequences by cost
    least = np.full(capacity + 1, np.inf)
    for i, size in enumerate(sizes):
        rooms[size].append((0.0, i))
        least[size] = 0.0
    waiting = [(-length, i, 0) for i, length in enumerate(lengths)]
    heapq.heapify(waiting)
    while waiting:
        minus, item, start = heapq.heappop(waiting)
        length = -minus
        room = length + int(np.argmin(least[length:]))
        if not rooms[room]:
            room = int(np.flatnonzero(least < np.inf)[-1])
            heapq.heappush(waiting, (room - length, item, start + room))
            length = room
        paid, seq = heapq.heappop(rooms[room])
        least[room] = rooms[room][0][0] if rooms[room] else np.inf
        yield item, start, length, seq, sizes[seq] - room
        if left := room - length:
            heapq.heappush(rooms[left], (paid + cost(length), seq))
            least[left] = rooms[left][0][0]


def pack_block(ids: list[np.ndarray], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of a block."""
    out, rests, seq = [], [], 0
    for d, x in enumerate(ids):
        for s in range(0, len(x) - capacity + 1, capacity):
            out.append((d, s, capacity, seq, 0))
            seq += 1
        if len(x) % capacity:
            rests.append((d, len(x) - len(x) % capacity))
    for i, s, n, q, o in assign([len(ids[d]) - at for d, at in rests], capacity):
        out.append((rests[i][0], rests[i][1] + s, n, seq + q, o))
    return out


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece.

    A document is its ids and one 0; a null or empty text is the 0 alone. Rows that repeat an id are documents of
    their own. sequence_id counts sequences within a task, above the task's number. An empty table gives no rows;
    other columns play no part.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = encoder(vocabulary), TaskContext.get().partitionId() << 32
        keys, ids, held = [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal first
            out = pack_block(ids, capacity)
            cols = [(s, n, zlib.crc32(ids[d][s : s + n].tobytes()), len(ids[d]), first + q, o) for d, s, n, q, o in out]
            first += 1 + max(q for _, _, _, q, _ in out)
            who = pa.array([keys[d] for d, *_ in out], type_)
            return pa.RecordBatch.from_arrays([who, *(pa.array(c, pa.int64()) for c in zip(*cols, strict=True))], ["doc_id", *names])

        type_ = None
        for b in batches:
            type_ = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.array([*encode(t.as_py()), END], "<u4")
                keys.append(k)
                ids.append(x)
                held += len(x)
                if held >= block:
                    yield packed()
                    keys, ids, held = [], [], 0
        if ids:
            yield packed()

    return rows.mapInArrow(lambda b: freed(run(b)), f"doc_id {kind}, " + ", ".join(f"`{n}` long" for n in names))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_vocabulary())
