"""Packing documents into token sequences of one length, with the attention cost of the sequences balanced.

A piece of L tokens costs ``linear * L + quadratic * L * L``: the feed-forward part and the attention inside its own
document. Pieces go in descending cost to the sequence that costs least so far and still has room; one that fits
nowhere is cut to fill the roomiest sequence, and its rest takes its turn later. Every partition packs its own rows in
a buffer of bounded size, and what doesn't fill a sequence moves on to the next buffer. So the job needs no shuffle,
no task holds more than one buffer, and only the last tokens of a partition are left over; these go into sequences
whose lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystat.llm.common import text_or_empty

COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = ", ".join(f"{c} long" for c in COLUMNS)

#: A piece: (key of its document, first token, number of tokens).
Piece = tuple[int, int, int]


def fill(pieces: list[Piece], rooms: list[int], linear: float, quadratic: float) -> tuple[list[list[Piece]], list[Piece]]:
    """Fills sequences of the given rooms; returns them and the pieces left over. All rooms are filled if there are tokens enough."""
    todo = [(-length, key, start) for key, start, length in pieces]
    heapq.heapify(todo)
    sequences: list[list[Piece]] = [[] for _ in rooms]
    left, cost = list(rooms), [0.0] * len(rooms)
    open_ = [(0.0, s) for s in range(len(rooms))]  # by cost
    small: list[tuple[int, int]] = []  # by room, largest first: too small for the pieces seen so far
    while todo and (open_ or small):
        minus, key, start = heapq.heappop(todo)
        length = -minus
        while small and -small[0][0] >= length:
            s = heapq.heappop(small)[1]
            heapq.heappush(open_, (cost[s], s))
        while open_ and left[open_[0][1]] < length:
            s = heapq.heappop(open_)[1]
            heapq.heappush(small, (-left[s], s))
        s = heapq.heappop(open_)[1] if open_ else heapq.heappop(small)[1]
        put = min(length, left[s])
        sequences[s].append((key, start, put))
        left[s] -= put
        cost[s] += linear * put + quadratic * put * put
        if left[s]:
            heapq.heappush(open_, (cost[s], s))
        if put < length:
            heapq.heappush(todo, (put - length, key, start + put))
    return sequences, [(key, start, -minus) for minus, key, start in todo]


def powers(n: int) -> list[int]:
    """The powers of two that sum to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def encoder(path: str | None) -> Callable[[str], np.ndarray]:
    """Text to ids, those of the tokenizer file. Texts that hold one of its added tokens go through that tokenizer; for
    all others its byte-level BPE is run over the same merges as ranks, which takes a fifth of the time."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    named = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    added = {t.content: i for i, t in named.get_added_tokens_decoder().items()}
    letters = {c: b for b, c in enumerate(bytes_as_letters())}
    ranks = {bytes(letters[c] for c in token): i for token, i in named.get_vocab(with_added_tokens=False).items()}
    for token in added:
        ranks.pop(token.encode(), None)
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(t in text for t in added):
            return np.array(named.encode(text, add_special_tokens=False).ids, np.int64)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


def bytes_as_letters() -> str:
    """The printable letter that byte-level vocabularies write for each byte: itself where it is printable Latin-1, else
    the next letter from code point 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


def pack_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    room: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
    buffer_tokens: int = 1 << 20,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long).

    Null and empty texts are documents of the end token alone. A null id stays null. Repeated rows are documents of
    their own. Ties go to the sequence opened first. Other columns are not read. An empty table gives no rows.
    ``tokenizer_path``: a byte-level BPE as a file of the tokenizers library (by default the public byte_bpe_50k); it
    must lie at this path on every executor. Strings of its added tokens become their ids. ``buffer_tokens`` bounds what a task holds. ``sequence_id`` holds the partition's number in its
    upper bits, so a task that runs again gives the same rows.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        ids: dict[int, np.ndarray] = {}  # the tokens of buffered documents, by the order they came in
        names: dict[int, int | None] = {}
        pieces: list[Piece] = []
        count, tokens, number = 0, 0, TaskContext.get().partitionId() << 40
        out: list[tuple] = []

        def emit(sequences: list[list[Piece]]) -> None:
            nonlocal number
            for sequence in filter(None, sequences):
                offset = 0
                for key, start, length in sequence:
                    crc = zlib.crc32(ids[key][start : start + length].tobytes())
                    out.append((names[key], start, length, crc, len(ids[key]), number, offset))
                    offset += length
                number += 1

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 7)], COLUMNS)
            out.clear()
            return made

        def flush(last: bool) -> None:
            nonlocal pieces, tokens
            sequences, rest = fill(pieces, [room] * (tokens // room), linear, quadratic)
            emit(sequences)
            if last and rest:
                for size in powers(sum(p[2] for p in rest)):
                    sequences, rest = fill(rest, [size], linear, quadratic)
                    emit(sequences)
            pieces, tokens = rest, sum(p[2] for p in rest)
            for key in ids.keys() - {p[0] for p in pieces}:
                del ids[key], names[key]

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.append(encode(text), end_id).astype("<u4")
                ids[count], names[count] = own, name
                whole = len(own) // room * room
                pieces += [(count, at, room) for at in range(0, whole, room)]
                if whole < len(own):
                    pieces.append((count, whole, len(own) - whole))
                tokens += len(own)
                count += 1
                if tokens >= buffer_tokens:
                    flush(False)
                    yield batch()
        flush(True)
        yield batch()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(pack, SCHEMA)
