"""Suffix-array deduplication: removal of every byte covered by a LENGTH-byte string that occurs earlier.

Sorting the suffixes of a whole corpus is neither needed nor affordable: only suffixes whose LENGTH-byte
prefix occurs twice matter.  So the work is anchored first and sorted after.

1. Anchors.  Each LENGTH-byte window picks the leftmost least hash of its GRAM-byte grams (winnowing).
   Equal windows pick the same place, so they meet at equal grams.  A gram's context is everything within
   LENGTH - GRAM bytes on both sides: all windows that hold the gram.
2. Equal contexts.  Occurrences of a gram with equal contexts are wholly repeated but for the first of
   them.  (Exact copies and the inside of repeated passages end here, whatever their number; batches send
   only their first of each, and mark the rest at once.)
3. Different contexts of one gram, the edges of repeats.  Every batch is a shard: it sorts its anchored
   suffixes once, by gram and what follows (and, mirrored, by what precedes), and ships the bytes on both
   sides in that order, its transform.  Merging begins with all shards' suffixes of a gram one shard after
   the other; each round of the interleave refinement reads one more byte through the interleave and parts
   it by that byte, stably, so suffixes are never sorted anew; what stands alone is left out of later
   rounds.  The round in which two neighbours part is their common prefix, and repeated intervals of
   prefix j are the runs between common prefixes below j.  Left intervals of depth j and right intervals of
   depth LENGTH - GRAM - j together give the groups of equal windows; all but the first of each are repeated.
   The contexts of a gram with more than COMMON of them are dealt out twice, with half of either side: equal
   windows agree on half of the left or half of the right side.
4. Spans are gathered by document, united and cut out.

Windows are compared by their bytes in step 3, by the 64-bit hash of the gram together with that of the
context in step 2.  The number of buckets follows the bytes of text, and buckets are worked on one by one.

Defined results: null text counts as empty; texts shorter than LENGTH bytes stay whole; documents are
ordered by id (null first), those of one id by a hash of their text; fully repeated rows are the same place
and keep what each of them would keep alone; an empty table gives an empty result; only the id (an integer)
and text columns are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import col, cut, deal, held, partitions, raw_values, released, returning, unpack
from .rolling import mix, prefix_sums, tables

#: Bytes of a repeat and of a gram; bytes hashed at once; entries refined at once.
LENGTH, GRAM, BUFFER, ENTRIES = 100, 32, 1 << 19, 30_000
#: Bytes of text whose anchors are combined before they are sent.
BATCH = 1 << 24
SIDE = LENGTH - GRAM
_U = np.uint64
#: Different contexts of one gram beyond which they are dealt out by half a side; bytes of text for each task.
COMMON, TASK_BYTES = 4096, 1 << 26
HALF = SIDE // 2
#: Whether all depths count, or only those of at most (right) or at least (left) HALF bytes on the left.
WHOLE, RIGHT, LEFT = 0, 1, 2
PLACE = np.dtype([("a", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("at", "<u8")])
#: rank: place of the suffix in its shard by what precedes it.
CONTEXT = np.dtype([("a", "<u8"), ("doc", "<i8"), ("at", "<u8"), ("part", "u1"), ("rank", "<u4"), ("nl", "u1"), ("nr", "u1"), ("left", "u1", SIDE), ("right", "u1", SIDE)])
def anchors(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts buffer[start:end] (in order, together the buffer): text number, place, gram hash, context hash."""
    n = len(buffer)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, _U),) * 2
    down = tables(n + 1)[2]
    prefix = prefix_sums(buffer)
    gram = mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1])
    # The place in the low bits makes the leftmost of equal hashes the least.
    key = gram >> _U(24) << _U(24) | np.arange(len(gram), dtype=_U)
    width = SIDE + 1
    padded = np.concatenate([key, np.full(-len(key) % width, 2**64 - 1, _U)]).reshape(-1, width)
    forward = np.minimum.accumulate(padded, 1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(backward[: len(key) - width + 1], forward[width - 1 : len(key)])
    inside = np.zeros(n + 1, np.int32)
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    place = np.unique((least[np.cumsum(inside)[: len(least)] > 0] & _U(0xFFFFFF)).astype(np.int64))
    text = np.searchsorted(ends, place, "right")
    low, high = np.maximum(starts[text], place - SIDE), np.minimum(ends[text], place + LENGTH)
    sides = ((place - low) * 256 + (high - place)).astype(_U)
    return text, place, gram[place], mix((prefix[high] - prefix[low]) * down[low] + mix(sides))


def places_of(docs: list[tuple[int, int, bytes]]) -> np.ndarray:
    """docs: (id, tie, bytes).  A PLACE for each anchor; `at` is tie << 32 | place in the document."""
    out = []
    group: list[tuple[int, int, int, bytes]] = []
    held = 0

    def flush() -> None:
        sizes = np.array([len(g[3]) for g in group], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        text, place, gram, context = anchors(np.frombuffer(b"".join(g[3] for g in group), np.uint8), starts, ends)
        found = np.empty(len(place), PLACE)
        found["a"], found["c"] = gram, context
        found["doc"] = np.array([g[0] for g in group], np.int64)[text]
        found["at"] = np.array([g[1] << 32 | g[2] for g in group], _U)[text] + (place - starts[text]).astype(_U)
        # Pieces of a long text: contexts cut by the piece's own ends are seen whole in its neighbour.
        keep = np.ones(len(place), bool)
        for i, g in enumerate(group):
            if len(g) > 4:
                of, p = text == i, place - starts[text]
                keep &= ~of | ((p >= g[4]) & (p < g[5]))
        out.append(found[keep])

    for doc, tie, raw in docs:
        if len(raw) < LENGTH:
            continue
        if len(raw) > BUFFER:
            for s in range(0, len(raw), BUFFER // 2):
                low, high = max(0, s - 2 * LENGTH), min(len(raw), s + BUFFER // 2 + 2 * LENGTH)
                if group:
                    flush()
                # Windows that start in [s, s + half) have their anchors in [s, s + half + SIDE].
                group = [(doc, tie, low, raw[low:high], s - low, min(s + BUFFER // 2 + SIDE, len(raw)) - low)]
                flush()
                group, held = [], 0
            continue
        if held + len(raw) > BUFFER and group:
            flush()
            group, held = [], 0
        group.append((doc, tie, 0, raw))
        held += len(raw)
    if group:
        flush()
    return np.concatenate(out) if out else np.empty(0, PLACE)


def first_of_contexts(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted places without double ones, whether each is the first of its gram and context)."""
    order = np.lexsort((places["at"], places["doc"], places["c"], places["a"]))
    places = places[order]
    if not len(places):
        return places, np.zeros(0, bool)
    same = (places["a"][1:] == places["a"][:-1]) & (places["c"][1:] == places["c"][:-1])
    double = same & (places["doc"][1:] == places["doc"][:-1]) & (places["at"][1:] == places["at"][:-1])
    keep = np.concatenate([[True], ~double])
    return places[keep], np.concatenate([[True], ~same])[keep]


def resolve(places: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places with a repeated context, first places whose gram has other contexts, whether it has over `limit`)."""
    order = np.argsort(places["a"], kind="stable")
    a = places["a"][order]
    again = np.concatenate([[False], a[1:] == a[:-1]]) if len(a) else np.zeros(0, bool)
    again[:-1] |= again[1:]
    places, first = first_of_contexts(places[order[again]])
    if not len(places):
        return places, places, np.zeros(0, bool)
    new = np.concatenate([[True], places["a"][1:] != places["a"][:-1]])
    gram = np.cumsum(new) - 1
    contexts = np.bincount(gram, first)
    edge = first & (contexts[gram] > 1)
    return places[~first], places[edge], contexts[gram[edge]] > limit


def contexts_of(raw: bytes, doc: int, tie: int, places: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """CONTEXT of the given places of a document; left bytes from the gram outwards."""
    n = len(raw)
    buffer = np.frombuffer(b"\0" * SIDE + raw + b"\0" * LENGTH, np.uint8)
    out = np.zeros(len(places), CONTEXT)
    out["a"], out["doc"], out["at"] = grams, doc, (tie << 32) + places.astype(_U)
    out["nl"], out["nr"] = np.minimum(places, SIDE), np.clip(n - places - GRAM, 0, SIDE)
    out["left"] = buffer[places[:, None] + SIDE - 1 - np.arange(SIDE)]
    out["right"] = buffer[places[:, None] + SIDE + GRAM + np.arange(SIDE)]
    return out


def halved(entries: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Entries, those of common grams twice: by the gram and half of the right side, and by half of the left side."""
    out = [entries[~common]]
    for part, side in ((RIGHT, "right"), (LEFT, "left")):
        found = entries[common]
        powers = tables(HALF)[1][:HALF]
        found["a"] = mix(found["a"] + (found[side][:, :HALF].astype(_U) + _U(part)) @ (powers * _U(part * 2 + 1)))
        found["part"] = part
        out.append(found)
    return np.concatenate(out)


def _words(side: np.ndarray) -> list[np.ndarray]:
    """Keys for lexsort, the last the most significant: the bytes, eight at a time."""
    padded = np.zeros((len(side), -(-SIDE // 8) * 8), np.uint8)
    padded[:, :SIDE] = side
    return list(padded.view(">u8").astype(_U).T[::-1])


def transform(entries: np.ndarray) -> np.ndarray:
    """A shard's entries in the order of gram and what follows; rank: their order by gram and what precedes."""
    entries = entries[np.lexsort([*_words(entries["right"]), entries["a"]])]
    entries["rank"][np.lexsort([*_words(entries["left"]), entries["a"]])] = np.arange(len(entries))
    return entries


def interleave(grams: np.ndarray, order: np.ndarray, side: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges sorted shards: order holds their entries gram by gram, and shard by shard within a gram.

    (entries in the merged order, common bytes of each with the one before it; -1: of another gram).
    """
    order = order.copy()
    m = len(order)
    prefix = np.where(np.concatenate([[True], grams[order][1:] != grams[order][:-1]]), -1, SIDE)
    block = np.cumsum(prefix < 0)
    active = np.arange(m)
    for j in range(SIDE):
        # Blocks of one entry are done with.
        inside = block[active]
        same = np.concatenate([[False], inside[1:] == inside[:-1]]) if len(active) else np.zeros(0, bool)
        active = active[same | np.append(same[1:], False)] if len(active) else active
        if not len(active):
            break
        inside, entry = block[active], order[active]
        ended = sizes[entry] <= j
        # An entry that has ended is alone from here on.
        byte = np.where(ended, 256 + np.arange(len(active)), side[entry, j].astype(np.int64))
        moved = np.lexsort((byte, inside))
        order[active], byte = entry[moved], byte[moved]
        parted = np.concatenate([[False], (inside[1:] == inside[:-1]) & (byte[1:] != byte[:-1])])
        prefix[active[parted]] = j
        # Numbers within a block only ever grow by parting it: they stay in the order of places.
        first = np.concatenate([[True], (inside[1:] != inside[:-1]) | (byte[1:] != byte[:-1])])
        block[active] = (m + 1) * (j + 1) + np.cumsum(first)
    return order, prefix


def intervals(order: np.ndarray, prefix: np.ndarray, depth: int) -> np.ndarray:
    """For each entry, the number of its interval of entries with that many common bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(prefix < depth)
    return out


def merge_shards(shards: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """shards: transforms (of whole grams).  (doc, tie, begin, end) of the repeated bytes."""
    out: list[tuple[int, int, int, int]] = []
    entries = np.concatenate(shards)
    shard = np.repeat(np.arange(len(shards)), [len(x) for x in shards])
    _, once = np.unique(entries[["a", "doc", "at"]], return_index=True)
    if len(once) < len(entries):  # fully repeated rows are one place
        once.sort()
        entries, shard = entries[once], shard[once]
    # Gram by gram, in the order of documents within it.
    by_place = np.lexsort((entries["at"], entries["doc"], entries["a"]))
    entries, shard, sent = entries[by_place], shard[by_place], by_place
    sizes = np.diff(np.flatnonzero(np.concatenate([[True], entries["a"][1:] != entries["a"][:-1], [True]])))
    # Whole grams, about ENTRIES entries at a time.
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // ENTRIES, prepend=-1))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for k, g in enumerate(cuts):
        low, high = bounds[g], bounds[cuts[k + 1]] if k + 1 < len(cuts) else len(entries)
        part, of, m = entries[low:high], shard[low:high], high - low
        right = interleave(part["a"], np.lexsort((sent[low:high], of, part["a"])), part["right"], part["nr"])
        left = interleave(part["a"], np.lexsort((part["rank"], of, part["a"])), part["left"], part["nl"])
        first_at, last_at = np.full(m, 1 << 30), np.full(m, -1)
        for j in range(SIDE + 1):
            l, r = intervals(*left, j), intervals(*right, SIDE - j)
            wanted = (part["part"] == WHOLE) | (part["part"] == (RIGHT if j <= HALF else LEFT)) | (part["part"] == LEFT) & (j == HALF)
            usable = np.flatnonzero(wanted & (part["nl"] >= j) & (part["nr"] >= SIDE - j) & (np.bincount(l, minlength=m + 1)[l] > 1) & (np.bincount(r, minlength=m + 1)[r] > 1))
            key = l[usable] * (m + 1) + r[usable]
            found = np.argsort(key, kind="stable")
            key = key[found]
            repeated = usable[found[1:][key[1:] == key[:-1]]]
            # A larger j is an earlier start: the window starts j bytes before the gram.
            first_at[repeated] = np.minimum(first_at[repeated], SIDE - j)
            last_at[repeated] = np.maximum(last_at[repeated], SIDE - j)
        hit = np.flatnonzero(last_at >= 0)
        place = (part["at"][hit] & _U(0xFFFFFFFF)).astype(np.int64)
        tie = (part["at"][hit] >> _U(32)).astype(np.int64)
        begin, end = place - SIDE + first_at[hit], place - SIDE + last_at[hit] + LENGTH
        out += zip(part["doc"][hit].tolist(), tie.tolist(), begin.tolist(), end.tolist())
    return out


def unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((begin, end))
    return out


def _blobs(records: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Records dealt into buckets by gram, in their order, one row for each bucket."""
    bucket, blob = deal((mix(records["a"]) % _U(buckets)).astype(np.int64), records, buckets)
    return pa.RecordBatch.from_arrays([bucket, blob], ["bucket", "blob"])


def _by_bucket(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[list[np.ndarray]]:
    """The blobs of one bucket after the other; rows come sorted by bucket."""
    current, blobs = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
            if blobs and bucket != current:
                yield blobs
                blobs = []
            current = bucket
            blobs.append(unpack(blob.as_buffer(), kind))
    if blobs:
        yield blobs


def _tie(raw: bytes) -> int:
    return zlib.crc32(raw) & 0x7FFFFFFF


def _marked(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """id, text, others (the columns `keep`), whole and cuts: what is repeated, not yet united."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(col(text_col))), F.lit(0))).first()[0]
    tasks = max(partitions(df.sparkSession), size // TASK_BYTES)
    buckets, limit = 4 * tasks, COMMON
    docs = df.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"), held(keep).alias("others"))

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list = []
        size = 0
        for batch in batches:
            for doc, raw in zip(batch.column("id").to_pylist(), raw_values(batch.column("text"))):
                waiting.append((doc if doc is not None else -(1 << 63), _tie(raw), raw))
                size += len(raw)
                if size >= BATCH:
                    yield _blobs(_combined(waiting), buckets)
                    waiting, size = [], 0
        if waiting:
            yield _blobs(_combined(waiting), buckets)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _by_bucket(batches, PLACE):
            places = np.concatenate(blobs)
            known = places["c"] == 0  # marked by its batch
            whole, edge, common = resolve(places[~known], limit)
            whole = np.concatenate([whole, places[known]])
            for part, kind in ((whole, None), (edge, common)):
                for k in range(0, len(part), 50_000):
                    p = part[k : k + 50_000]
                    gram = pa.nulls(len(p), pa.int64()) if kind is None else pa.array(p["a"].view(np.int64))
                    many = pa.nulls(len(p), pa.bool_()) if kind is None else pa.array(kind[k : k + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array(p["doc"]), pa.array((p["at"] >> _U(32)).astype(np.int64)), pa.array((p["at"] & _U(0xFFFFFFFF)).astype(np.int32)), gram, many], ["doc", "tie", "place", "gram", "common"])

    marks = docs.select("id", "text").mapInArrow(returning(anchor), "bucket long, blob binary").repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(returning(settle), "doc long, tie long, place int, gram long, common boolean")
    edge = F.col("gram").isNotNull()
    by_doc = cut(
        marks.groupBy("doc", "tie").agg(
            F.collect_list(F.when(~edge, F.col("place"))).alias("whole"), F.collect_list(F.when(edge, F.col("place"))).alias("edge"), F.collect_list("gram").alias("grams"), F.collect_list("common").alias("commons")
        )
    )
    # Keys that cannot be null: else one use of `found` would filter nulls and shuffle the texts on its own.
    tie = F.coalesce(F.crc32(F.encode("text", "UTF-8")).bitwiseAND(F.lit(0x7FFFFFFF)).cast("long"), F.lit(0).cast("long"))
    keyed = docs.select(F.coalesce("id", F.lit(-(1 << 63))).alias("doc"), tie.alias("tie"), "id", "text", "others")
    found = keyed.join(by_doc.hint("shuffle_hash"), ["doc", "tie"], "left")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, count = [], 0
        for batch in batches:
            for i, (doc, tie, raw) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("tie").to_pylist(), raw_values(batch.column("text")))):
                places = batch.column("edge")[i].values.to_numpy().astype(np.int64)
                grams = batch.column("grams")[i].values.to_numpy().view(_U)
                order = np.argsort(grams, kind="stable")
                commons = batch.column("commons")[i].values.to_numpy(zero_copy_only=False).astype(bool)
                found = contexts_of(raw, doc, tie, places[order], grams[order])
                parts.append(halved(found, commons[order]) if commons.any() else found)
                count += len(places)
                if count >= 40_000:
                    yield _blobs(transform(np.concatenate(parts)), buckets)
                    parts, count = [], 0
        if parts:
            yield _blobs(transform(np.concatenate(parts)), buckets)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards in _by_bucket(batches, CONTEXT):
            spans = merge_shards(shards)
            for k in range(0, len(spans), 50_000):
                columns = list(zip(*spans[k : k + 50_000]))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], ["doc", "tie", "begin", "end"])

    # All columns of `found`, so that both uses of it share its exchanges.
    edged = found.where(F.size("edge") > 0)
    spans = edged.mapInArrow(returning(edges), "bucket long, blob binary").repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(returning(merge), "doc long, tie long, begin int, end int")
    cuts = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("begin", "end")).alias("cuts"))
    return found.join(cuts.hint("shuffle_hash"), ["doc", "tie"], "left")


def _spans_of(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """The bytes and the united repeated spans of each row of _marked."""
    for raw, whole, more in zip(raw_values(batch.column("text")), batch.column("whole").to_pylist(), batch.column("cuts").to_pylist()):
        yield raw, unite([(max(0, p - SIDE), min(len(raw), p + LENGTH)) for p in whole or ()] + [(c["begin"], c["end"]) for c in more or ()])


def repeated_spans(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and spans (array of begin, end in bytes, united) for each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = [[{"begin": b, "end": e} for b, e in spans] for _, spans in _spans_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(out, kind)], ["id", "text", "spans"])

    spanned = _marked(df, id_col, text_col, ()).mapInArrow(run, "id long, text string, spans array<struct<begin: long, end: long>>")
    return spanned.withColumnsRenamed({"id": id_col, "text": text_col})


def digest(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 for each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(raw), sum(e - b for b, e in cuts), len(cuts), hashlib.sha256(kept_bytes(raw, cuts)).hexdigest()) for raw, cuts in _spans_of(batch)]
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _marked(df, id_col, text_col, ()).mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def cut_texts(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the kept text (characters that were cut in the middle go) and the columns `keep` for each row of df."""
    marked = _marked(df, id_col, text_col, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [kept_bytes(raw, cuts).decode(errors="ignore") for raw, cuts in _spans_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string()), batch.column("others")], ["id", "text", "others"])

    out = marked.mapInArrow(run, StructType([StructField("id", LongType()), StructField("text", StringType()), marked.schema["others"]]))
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), *released(keep, F.col("others")))


def _combined(docs: list[tuple[int, int, bytes]]) -> np.ndarray:
    """Places of a batch; those that are not the first of their context here are only marks (c = 0)."""
    places, first = first_of_contexts(places_of(docs))
    places = places.copy()
    places["c"] |= _U(1)  # 0 is taken by marks
    later = ~first
    places["c"][later] = 0
    places["a"][later] = mix(places["at"][later] * _U(31) + places["doc"][later].view(_U))  # spread
    return places


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for begin, end in spans:
        out.append(raw[at:begin])
        at = end
    return b"".join([*out, raw[at:]])
