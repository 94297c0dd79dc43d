"""Packing by order-preserving dynamic programming.

The documents of a partition, in their order, form one stream of token ids (each document ends with
END).  Windows of at most `length` ids are cut from it.  Allowed cuts are the ends of documents (free),
the ends of sentences (SENTENCE), and, every HARD_STEP ids, any place (HARD).  The cuts minimise the sum
of padding and penalties: with cost(j) the least cost of the stream up to cut j at place p(j),

    cost(j) = penalty(j) + length - p(j) + min { cost(i) + p(i) : p(j) - length <= p(i) < p(j) }

whose window minimum a monotone queue gives in constant time.  The stream is packed a block at a time
(BLOCK_IDS ids), what is left of the last window being carried on, so memory is bounded.  The remainder
of a partition is cut into powers of two, which need no padding.

Defined results: a null text is an empty document (its only id is END); repeated rows are packed as often
as they come; a very long document spans several windows; an empty table gives an empty result; only the
id and text columns are read, so other columns (of whatever name) do not matter.  Sequence ids hold the
partition's number in their upper bits and count from 0 in it.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _TOKENIZERS, col, slices

END = 1
#: Penalties, in ids of padding, and the distance of the cuts that ignore sentences.
SENTENCE, HARD, HARD_STEP = 2, 24, 64
BLOCK_IDS = 1 << 18


@dataclass(frozen=True)
class FastTokenizer:
    """A byte-level BPE vocabulary in the tiktoken library.

    Its ids are those of the tokenizers library (tests compare them), about four times as fast.
    """

    encoding: object
    special: re.Pattern | None
    #: Bytes of each id, and whether it ends a sentence.
    sizes: np.ndarray
    ends: np.ndarray

    def ids(self, text: str) -> np.ndarray:
        """Special strings count as special, the tokenizers library's default."""
        if self.special is not None and self.special.search(text):
            return np.array(self.encoding.encode(text, allowed_special="all"), np.uint32)
        return self.encoding.encode_to_numpy(text)

    def plain_ids(self, text: str) -> np.ndarray:
        """Special strings are ordinary text."""
        return self.encoding.encode_to_numpy(text, disallowed_special=())


def fast_tokenizer(path: str) -> FastTokenizer:
    """The tokenizer of a byte-level BPE file, once per Python process."""
    if ("fast", path) in _TOKENIZERS:
        return _TOKENIZERS["fast", path]
    import json

    import public_tokenizers
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    # The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for 256, 257, ...
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["special"]}
    words = {bytes(back[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(words, spec["model"]["merges"], back), special_tokens=special)
    found = re.compile("|".join(map(re.escape, special))) if special else None
    count = max([*words.values(), *special.values()]) + 1
    sizes, ends = np.zeros(count, np.int64), np.zeros(count, bool)
    for w, i in [*words.items(), *((c.encode(), i) for c, i in special.items())]:
        sizes[i] = len(w)
    ends[[i for w, i in words.items() if w[-1:] in b".!?\n"]] = True
    _TOKENIZERS["fast", path] = FastTokenizer(encoding, found, sizes, ends)
    return _TOKENIZERS["fast", path]


def _ranks(words: dict[bytes, int], merges: list, back: dict[str, int]) -> dict[bytes, int]:
    """tiktoken merges by id: ids must rise with the order of merges, as they do in this family of files."""
    order = []
    for m in merges:
        a, b = m.split(" ") if isinstance(m, str) else m
        order.append(words[bytes(back[c] for c in a + b)])
    if any(x >= y for x, y in zip(order, order[1:])):
        raise ValueError("the ids of this vocabulary do not follow its merges")
    return words


def best_cuts(places: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """Indexes of the cuts to make, the last always among them.

    places: rising places of the allowed cuts, all gaps at most length; the stream begins at 0.
    """
    n = len(places)
    p, pen = places.tolist(), penalties.tolist()
    key = [0] * (n + 1)  # cost(i) + p(i); entry 0 is the beginning
    came = [0] * (n + 1)
    at = [0, *p]
    queue: deque[int] = deque([0])
    for j in range(1, n + 1):
        here = at[j]
        while at[queue[0]] < here - length:
            queue.popleft()
        i = queue[0]
        came[j] = i
        k = key[i] + length + pen[j - 1]  # cost(j) + p(j), as p(j) cancels
        key[j] = k
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts, j = [], n
    while j:
        cuts.append(j - 1)
        j = came[j]
    return cuts[::-1]


def allowed_cuts(ids: np.ndarray, ends: np.ndarray, doc_ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (rising, the last is len(ids)) and penalties of the cuts that a stream allows."""
    n = len(ids)
    penalty = np.full(n + 1, HARD * 1000, np.int64)
    step = min(HARD_STEP, length)
    penalty[step::step] = HARD
    penalty[1:][ends[ids]] = SENTENCE
    penalty[doc_ends] = 0
    penalty[n] = 0
    places = np.flatnonzero(penalty < HARD * 1000)
    places = places[places > 0]
    return places, penalty[places]


def pack_documents(documents: Iterator[tuple[object, np.ndarray]], ends: np.ndarray, *, length: int = 2048, block_ids: int = BLOCK_IDS) -> Iterator[tuple]:
    """documents: (key, ids with END).  Yields (key, start, ids, doc_tokens, sequence, offset) of each piece."""
    pending: list[list] = []  # [key, ids, total, done]
    sequence, held = 0, 0

    def flush(final: bool) -> Iterator[tuple]:
        nonlocal pending, sequence, held
        if not held:
            return
        stream = np.concatenate([d[1][d[3] :] for d in pending])
        doc_ends = np.cumsum([d[2] - d[3] for d in pending])
        places, penalties = allowed_cuts(stream, ends, doc_ends, length)
        cuts = places[best_cuts(places, penalties, length)].tolist()
        if final:
            begin = cuts[-2] if len(cuts) > 1 else 0
            cuts.pop()
            left = len(stream) - begin
            if left <= length * 31 // 32 or left & (left - 1) == 0:
                while left:  # powers of two need no padding
                    size = min(length, 1 << left.bit_length() - 1)
                    begin += size
                    left -= size
                    cuts.append(begin)
            else:
                cuts.append(len(stream))
        elif len(cuts) > 1:
            cuts.pop()  # the last window may still grow
        at, k = 0, 0
        for cut in cuts:
            offset = 0
            while at < cut:
                key, ids, total, done = pending[k]
                size = min(cut - at, total - done)
                yield key, done, ids[done : done + size], total, sequence, offset
                offset += size
                at += size
                pending[k][3] += size
                k += pending[k][3] == total
            sequence += 1
        pending = pending[k:]
        held = len(stream) - at

    for key, ids in documents:
        pending.append([key, ids, len(ids), 0])
        held += len(ids)
        if held >= block_ids:
            yield from flush(False)
    yield from flush(True)


def pack(df: DataFrame, tokenizer_file: str, *, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    base = df.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"), F.spark_partition_id().alias("part"))
    id_type = base.schema["id"].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = fast_tokenizer(tokenizer_file)
        out: list[tuple] = []
        id_field, part = None, 0

        def documents() -> Iterator[tuple]:
            nonlocal id_field, part
            for batch in slices(batches, "text", 1 << 22):
                id_field = batch.schema.field("id").type
                if batch.num_rows:
                    part = batch.column("part")[0].as_py()
                for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                    yield key, np.append(tokenizer.ids(text), np.uint32(END))

        def table() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            arrays = [pa.array(columns[0], id_field), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            if with_ids:
                arrays.append(pa.array(columns[7], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, ["id", *names, *(["ids"] if with_ids else [])])

        for key, start, ids, total, sequence, offset in pack_documents(documents(), tokenizer.ends, length=length):
            crc = zlib.crc32(ids.astype("<u4", copy=False).tobytes())
            out.append((key, start, len(ids), crc, total, part << 36 | sequence, offset, ids if with_ids else None))
            if len(out) >= 8192:
                yield table()
        if out:
            yield table()

    schema = f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return base.mapInArrow(run, schema).withColumnRenamed("id", id_col)

