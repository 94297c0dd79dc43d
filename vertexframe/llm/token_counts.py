r"""Token counts by overlap resynchronisation.

A text of up to a chunk and its overlap is encoded whole, in the task that scans it.  A huge text is cut
into chunks that overlap, the chunks are dealt out over the cluster and encoded with offsets, and the
counts are spliced at a boundary that lies in both neighbours.

A boundary is a place that no token can cross and before which nothing bears on what follows, whatever the
text.  `boundary_rule` proves from the vocabulary's file where such places are, and raises ValueError for a
file for which it cannot:

* after white space, where words are split by a pattern whose alternatives are fixed strings and classes
  of characters without white space, and white space is dropped: no match, no composition of characters
  and no special string reaches across white space;
* before a single space between two other characters, where words are split by the usual byte-level
  pattern: a run of one space always begins the next word.

If the overlap holds no boundary, it is widened: the left chunk is joined with 1, 2, 4 ... of its
successors and encoded again, in the worst case (no boundary at all) up to the whole text.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated results;
an empty table gives an empty result; only the id and text columns are read, so other columns (of
whatever name) do not matter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, hf_tokenizer, partitions, raw_values, slices

#: Characters before a cut that are not trusted (longer than any special string or contraction).
MARGIN = 32
#: Unicode's White_Space property (fixed values).
WHITE_SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
AFTER, BEFORE = re.compile(f"(?<=[{WHITE_SPACE}])(?=[^{WHITE_SPACE}])"), re.compile(f"(?<=[^{WHITE_SPACE}])(?= [^{WHITE_SPACE}])")
#: Normalisations of single characters and their combining marks, none of which are white space.
_LOCAL = ("NFC", "NFD", "NFKC", "NFKD", "Lowercase")


def boundary_rule(path: str) -> re.Pattern:
    """What finds the boundaries in texts for this vocabulary file; ValueError if none is proven."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    for token in spec.get("added_tokens") or []:
        if any(token.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) or set(token["content"]) & set(WHITE_SPACE) or len(token["content"]) > MARGIN:
            raise ValueError(f"the added token {token['content']!r} can reach across white space")
    steps = _flat(spec.get("normalizer"), "normalizers")
    runs = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    if any(s["type"] not in _LOCAL and s != runs for s in steps):
        raise ValueError("the normalisation is not known to keep to one side of white space")
    splits = _flat(spec.get("pre_tokenizer"), "pretokenizers")
    first, *more = splits or [{"type": None}]
    if first["type"] == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not more and not steps:
        return BEFORE
    plain = all(s["type"] == "ByteLevel" and not s.get("use_regex", True) and not s.get("add_prefix_space") for s in more)
    if first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and plain and all(_without_space(x) for x in first["pattern"]["Regex"].split("|")):
        return AFTER
    raise ValueError("its words are not known to end at white space")


def _flat(step: dict | None, inner: str) -> list[dict]:
    return [] if step is None else step[inner] if step["type"] == "Sequence" else [step]


def _without_space(alternative: str) -> bool:
    """Whether this is a string, or one class (repeated or not), that matches no white space."""
    import regex

    one = re.fullmatch(r"(\[[^\[\]]+\])\+?", alternative)
    if one is None and not re.fullmatch(r"[\w']+", alternative):
        return False
    return not any(regex.search(one[1] if one else alternative, c) for c in WHITE_SPACE)


def encode_chunk(tokenizer, rule: re.Pattern, text: str, base: int, zones: list[tuple[int, int]] | None = None) -> tuple[int, list[int], list[int]]:
    """Tokens of a chunk; its boundaries (in the whole text); the index of the first token after each.

    zones: the parts of the chunk in which boundaries are wanted (default: everywhere).
    """
    ends = np.array([e for _, e in tokenizer.encode(text, add_special_tokens=False).offsets], np.int64)
    at = [m.start() for low, high in zones or [(0, len(text))] for m in rule.finditer(text, low, high)]
    return len(ends), [base + p for p in at], np.searchsorted(ends, np.array(at, np.int64), "right").tolist()


def cut_chunks(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(start, text) of the overlapping chunks; the last ends with the text."""
    starts = list(range(0, max(1, len(text) - overlap), chunk))
    return [(s, text[s : s + chunk + overlap] if s != starts[-1] else text[s:]) for s in starts]


def splice(chunks: list[dict], tokenizer, rule: re.Pattern) -> int:
    """Tokens of the whole text from its encoded chunks, in order (start, text, n, at, index)."""
    total, k = 0, 0
    left = dict(chunks[0])
    begin, since = 0, left["start"]  # of what is still to be counted: index in `left`, and place
    while k + 1 < len(chunks):
        step = 1
        while True:
            right = chunks[k + 1]
            end = left["start"] + len(left["text"])
            ours = {p: i for p, i in zip(left["at"], left["index"]) if max(since, right["start"]) <= p <= end - MARGIN}
            common = next(((p, i) for p, i in zip(right["at"], right["index"]) if p in ours), None)
            if common is not None:
                since, there = common
                total += ours[since] - begin
                left, begin, k = dict(right), there, k + 1
                break
            # No boundary in the overlap: widen it over the next `step` chunks.
            for other in chunks[k + 1 : k + 1 + step]:
                left["text"] += other["text"][left["start"] + len(left["text"]) - other["start"] :]
                k += 1
            left["text"], left["start"], begin = left["text"][since - left["start"] :], since, 0
            left["n"], left["at"], left["index"] = encode_chunk(tokenizer, rule, left["text"], since)
            step *= 2
            if k + 1 >= len(chunks):
                break
    return total + left["n"] - begin


def count_spliced(tokenizer, rule: re.Pattern, text: str, chunk: int, overlap: int) -> int:
    """The same on one machine, for one text."""
    chunks = []
    for start, piece in cut_chunks(text, chunk, overlap):
        n, at, index = encode_chunk(tokenizer, rule, piece, start)
        chunks.append({"start": start, "text": piece, "n": n, "at": at, "index": index})
    return splice(chunks, tokenizer, rule)


def token_counts(
    df: DataFrame,
    tokenizer_file: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    chunk_chars: int = 32768,
    overlap_chars: int = 512,
) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each row of df.

    Texts of up to chunk_chars + overlap_chars characters never leave the task that scans them; only
    longer ones are cut, dealt out and gathered again by row.
    """
    if overlap_chars <= MARGIN or chunk_chars <= overlap_chars:
        raise ValueError("chunk_chars > overlap_chars > MARGIN is needed")
    rule = boundary_rule(tokenizer_file)
    longest = chunk_chars + overlap_chars
    base = df.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    id_type = base.schema["id"].dataType.simpleString()
    short = base.where(F.length("text") <= longest)
    huge = base.where(F.length("text") > longest).withColumn("row_key", F.monotonically_increasing_id())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = hf_tokenizer(tokenizer_file)
        for batch in slices(batches, "text", 1 << 20):
            counts = [len(e) for e in tokenizer.encode_batch_fast(batch.column("text").to_pylist(), add_special_tokens=False)]
            sizes = [len(raw) for raw in raw_values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    piece_type = pa.schema([("row_key", pa.int64()), ("n_bytes", pa.int64()), ("chunk", pa.int64()), ("start", pa.int64()), ("piece", pa.string())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 22):
            for i, (key, text) in enumerate(zip(batch.column("row_key").to_pylist(), batch.column("text").to_pylist())):
                pieces = cut_chunks(text, chunk_chars, overlap_chars)
                n, size = len(pieces), len(text.encode())
                rest = pa.RecordBatch.from_pydict({"row_key": [key] * n, "n_bytes": [size] * n, "chunk": list(range(n)), "start": [s for s, _ in pieces], "piece": [p for _, p in pieces]}, piece_type)
                ids = pa.concat_arrays([batch.column("id").slice(i, 1)] * n)
                yield pa.RecordBatch.from_arrays([ids, *rest.columns], ["id", *rest.schema.names])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = hf_tokenizer(tokenizer_file)
        for batch in slices(batches, "piece", 1 << 22):
            n, at, index = [], [], []
            for start, piece in zip(batch.column("start").to_pylist(), batch.column("piece").to_pylist()):
                # Only the two overlaps are needed for splicing; a chunk may end in the middle of the second one.
                zones = [(0, min(overlap_chars, len(piece))), (chunk_chars, len(piece))] if len(piece) > chunk_chars else None
                count, places, indexes = encode_chunk(tokenizer, rule, piece, start, zones)
                n.append(count)
                at.append(places)
                index.append(indexes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int64())), pa.array(index, pa.list_(pa.int64()))],
                [*batch.schema.names, "n", "at", "index"],
            )

    def gather(group: pa.Table) -> pa.Table:
        tokenizer = hf_tokenizer(tokenizer_file)
        rows = sorted(group.select(["chunk", "start", "piece", "n", "at", "index"]).to_pylist(), key=lambda r: r["chunk"])
        for r in rows:
            r["text"] = r.pop("piece")
        return pa.Table.from_arrays(
            [group.column("id").slice(0, 1), group.column("n_bytes").slice(0, 1), pa.array([splice(rows, tokenizer, rule)], pa.int64())],
            ["id", "n_bytes", "n_tokens"],
        )

    result = f"id {id_type}, n_bytes long, n_tokens long"
    dealt = f"id {id_type}, row_key long, n_bytes long, chunk long, start long, piece string"
    pieces = huge.mapInArrow(deal, dealt).repartition(partitions(df.sparkSession), "row_key", "chunk")
    encoded = pieces.mapInArrow(encode, f"{dealt}, n long, at array<long>, index array<long>")
    counted = short.select("id", "text").mapInArrow(whole, result).unionByName(encoded.groupBy("row_key").applyInArrow(gather, result))
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
