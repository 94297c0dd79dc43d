r"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's A-Z are lower-cased, its words are `[^\x20\x09-\x0D]+`, its shingles are runs of `shingle` words
(repeats count; fewer words: the whole sequence), and bit b of its fingerprint is 1 if bit b is set in
over half of the shingles' XXH64 hashes (seed 42).  A text without words has fingerprint 0.

Fingerprints that differ in at most t bits are found without comparing all pairs.  The 64 bits are split
into m partitions, correlated bits together (so that the others stay selective), and partition i gets a
threshold t_i >= -1 (-1: never probed) with sum(t_i + 1) = t + 1: by the pigeonhole principle, a pair
within t bits differs in at most t_i bits of some partition i.  The thresholds (and m) are those of least
estimated cost, found by dynamic programming over partitions on candidate counts estimated from a bounded
sample; any choice gives the same links.  Distinct fingerprints are indexed by their partition's bits,
probed with all values within t_i bits of theirs, and verified by the distance over all 64 bits in the
join itself.  Components come from star contraction, over links between distinct fingerprints only, so a
group of equal texts is a single node; a crowd of near fingerprints is joined by a few links for each
member first, and then only links between different components are made.

Defined results: null text counts as empty; texts without words are linked with each other and whatever
is near 0; rows with a null id are components of their own texts like others (null ids never name a
component unless alone); repeated rows are kept; an empty table gives an empty result; only the id and
text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut, deal, gather, in_parts, partitions, raw_values, release, returning, slices, small
from .components import connected_components, contracted, roots
from .rolling import mix, shingle_set, similarity

SEED, BITS = 42, 64
#: Fingerprints that correlations and candidate counts are estimated from.
SAMPLE = 4000
#: Near texts that each text is compared with before all the rest.
NEAREST = 4
#: Cost of a probed key in candidates.
KEY_COST = 4
#: Most common shingles, as a sample of texts shows them: at most so many, and in how many texts of the sample.
MAX_COMMON, MIN_COMMON = 20_000, 4


def shingles(text: str | None, size: int) -> list[bytes]:
    return shingles_of((text or "").encode(), size)


def shingles_of(raw: bytes, size: int) -> list[bytes]:
    words = raw.lower().split()
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each shingle of one word or more."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(joined, SEED)], "<u8")
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :])], "<u8")


def fingerprint_of(words: list[bytes], size: int) -> int:
    """Unsigned 64-bit fingerprint of lower-case words."""
    if not words:
        return 0
    hashes = shingle_hashes(words, size)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, size: int) -> int:
    return fingerprint_of((text or "").encode().lower().split(), size)


def prefix(found: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a sorted set, those of the sorted `common` last, of which two sets of a Jaccard similarity of `least` share one.

    Such sets share at least `least` of either's elements, so the first shared one in any fixed order has
    no more than 1 - `least` of either set before it.
    """
    if not len(common):
        return found[: len(found) - ceil(least * len(found) - 1e-9) + 1]
    late = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
    return np.concatenate([found[~late], found[late]])[: len(found) - ceil(least * len(found) - 1e-9) + 1]


def fingerprints(df: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the 64 bits as a signed long) for each row."""
    base = df.select(col(id_col).alias("id"), col(text_col).alias("t"))
    id_type = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 1 << 23):
            found = np.array([fingerprint_of(raw.lower().split(), shingle) for raw in raw_values(batch.column("t"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    return base.mapInArrow(run, f"id {id_type}, fp long").withColumnRenamed("id", id_col)


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """bits (sample, 64) -> m groups of equal size (but for the last), correlated bits together."""
    varying = bits.std(0) > 0 if len(bits) else np.zeros(BITS, bool)
    correlation = np.zeros((BITS, BITS))
    if varying.sum() > 1 and len(bits) > 2:
        picked = np.flatnonzero(varying)
        correlation[np.ix_(picked, picked)] = np.abs(np.corrcoef(bits[:, picked], rowvar=False))
    np.fill_diagonal(correlation, 0)
    left, groups = list(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        inner = correlation[np.ix_(left, left)]
        group = [left[int(inner.sum(1).argmax())]]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(rest[int(correlation[np.ix_(rest, group)].mean(1).argmax())])
        groups.append(sorted(group))
        left = [b for b in left if b not in group]
    return groups


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """costs[i][t + 1]: cost of threshold t (from -1) for partition i.  Least total with sum(t + 1) = budget."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for spent, cost in enumerate(row):
                if used + spent <= budget and (used + spent not in new or total + cost < new[used + spent][0]):
                    new[used + spent] = (total + cost, [*chosen, spent - 1])
        best = new
    return best[budget]


def plan(sample: np.ndarray, n: int, distance: int) -> list[tuple[int, int]]:
    """(mask, threshold) of the probed partitions; sample: uint64 fingerprints, n: all of them."""
    n = max(n, 1000)  # below that, costs say nothing
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8)
    half = len(sample) // 2
    a, b = bits[:half].astype(np.float32), bits[half : 2 * half].astype(np.float32)
    best = (float("inf"), [])
    for m in range(2, 5):
        groups, costs = group_bits(bits, m), []
        for group in groups:
            x, y = a[:, group], b[:, group]
            apart = (x.sum(1)[:, None] + y.sum(1)[None, :] - 2 * x @ y.T) if half else np.zeros((0, 0))
            row = [0.0]
            for t in range(distance + 1):
                ball = sum(comb(len(group), k) for k in range(t + 1))
                # The sample sees no rare chance: never below that of even bits.
                chance = max(float((apart <= t + 0.5).mean()) if apart.size else 0.0, ball / 2.0 ** len(group))
                row.append(n * (1 + ball) * KEY_COST + n * n / 2 * chance)
            costs.append(row)
        total, chosen = allocate(costs, distance + 1)
        if total < best[0]:
            best = (total, [(sum(1 << b for b in g), t) for g, t in zip(groups, chosen) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _probes(distinct: DataFrame, parts: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """(u, part, key) by the bits of each partition; (v, part, key) with all values within its threshold."""
    index = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(_signed(mask)).alias("mask")) for i, (mask, _) in enumerate(parts)])
    flips = []
    for i, (mask, t) in enumerate(parts):
        places = [b for b in range(BITS) if mask >> b & 1]
        for k in range(t + 1):
            flips += [F.struct(F.lit(i).alias("part"), F.lit(_signed(mask)).alias("mask"), F.lit(_signed(sum(1 << b for b in c))).alias("flip")) for c in combinations(places, k)]
    kept = [c for c in distinct.columns if c != "fp"]
    left = distinct.select(F.col("fp").alias("u"), *kept, F.explode(index).alias("p")).select("u", *kept, F.col("p.part").alias("part"), F.col("u").bitwiseAND(F.col("p.mask")).alias("key"))
    right = distinct.select(F.col("fp").alias("v"), *kept, F.explode(F.array(*flips)).alias("p")).select(
        "v", *kept, F.col("p.part").alias("part"), F.col("v").bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip")).alias("key")
    )
    return left, right


def _plan_of(distinct: DataFrame, distance: int, n: int) -> list[tuple[int, int]]:
    """Partitions and thresholds by a bounded sample: the fingerprints of the least hashes, picked where they lie."""
    share = max(1, n // SAMPLE)
    sample = [r.fp for r in distinct.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0).select("fp").limit(2 * SAMPLE).collect()]
    return plan(np.array(sorted(sample), np.int64).view(np.uint64), n, distance)


def _near(parts: list[tuple[int, int]], distance: int) -> Column:
    """Whether u and v are within the distance, for the first partition in which they are (and only there)."""
    apart = F.col("u").bitwiseXOR(F.col("v"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(apart) <= distance)
    for i, (mask, t) in enumerate(parts):
        near = near & ((F.col("l.part") <= i) | (F.bit_count(apart.bitwiseAND(F.lit(_signed(mask)))) > t))
    return near


def links(distinct: DataFrame, distance: int, *, n: int | None = None) -> DataFrame:
    """distinct (fp) -> (u, v): each pair u < v of fingerprints that differ in at most `distance` bits."""
    n = distinct.count() if n is None else n
    parts = _plan_of(distinct, distance, n)
    left, right = _probes(distinct.select("fp"), parts)
    pairs = left.alias("l").join(right.alias("r"), (F.col("l.part") == F.col("r.part")) & (F.col("l.key") == F.col("r.key")) & _near(parts, distance))
    return pairs.select("u", "v")


def first_links(distinct: DataFrame, distance: int) -> DataFrame:
    """distinct (fp, name) -> (u, v, a, b): of the fingerprints that agree on three quarters of their bits, each (v, of name b)
    with the least (u, of name a), if it is within the distance.

    At most four for each fingerprint, whatever the size of a crowd of near ones.
    """
    quarters = F.array(*[F.struct(F.lit(k).alias("part"), F.lit(_signed(~(0xFFFF << 16 * k) & (1 << BITS) - 1)).alias("mask")) for k in range(4)])
    keyed = distinct.select("fp", "name", F.explode(quarters).alias("p")).select("fp", "name", F.col("p.part").alias("part"), F.col("fp").bitwiseAND(F.col("p.mask")).alias("key"))
    least = keyed.groupBy("part", "key").agg(F.min(F.struct("fp", "name")).alias("x"), F.max("fp").alias("most")).where("x.fp < most")
    found = keyed.join(small(cut(least.select("part", "key", F.col("x.fp").alias("u"), F.col("x.name").alias("a")))), ["part", "key"])
    near = found.where((F.col("u") < F.col("fp")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("fp"))) <= distance))
    return near.select("u", F.col("fp").alias("v"), "a", F.col("name").alias("b")).distinct()


def joining_links(distinct: DataFrame, distance: int) -> DataFrame:
    """distinct (fp, name) -> (u, v, a, b): links of at most `distance` bits, and the names of their ends, that join all
    fingerprints that any such links join.

    First each fingerprint's links of first_links, so a crowd becomes one component at the cost of a few
    links for each member; then all pairs that stand in different components by then.
    """
    n = distinct.count()
    early = cut(first_links(distinct, distance))
    found = connected_components(early.select("u", "v"))
    rooted = cut(distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "name", F.coalesce("root", "fp").alias("root")))
    parts = _plan_of(distinct, distance, n)
    left, right = _probes(rooted, parts)
    same = (F.col("l.part") == F.col("r.part")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.root") != F.col("r.root"))
    late = left.alias("l").join(right.alias("r"), same & _near(parts, distance)).select("u", "v", F.col("l.name").alias("a"), F.col("r.name").alias("b"))
    return early.union(late)


def near_duplicates(df: DataFrame, *, distance: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hexadecimal digits), component_id (least id reachable) for each row."""
    marked = cut(fingerprints(df, shingle=shingle, id_col=id_col, text_col=text_col).withColumnRenamed(id_col, "id"))
    distinct = cut(marked.groupBy("fp").agg(F.min("id").alias("least")))
    known = connected_components(joining_links(distinct.select("fp", F.col("fp").alias("name")), distance).select("u", "v"))
    members = distinct.join(known, distinct["fp"] == known["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = members.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = members.join(named, "root").select("fp", "component_id")
    out = marked.join(classes, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Of a shingle in the prefix of a text: hash, text, size of the text's set, place in its order (65535: there or later).
ENTRY = np.dtype([("s", "<u8"), ("key", "<u8"), ("n", "<u4"), ("i", "<u2")])
#: The same with the fingerprint and the component of the text.
ROOTED = np.dtype([*ENTRY.descr, ("fp", "<u8"), ("root", "<u8")])
NODE = np.dtype([("key", "<u8"), ("fp", "<u8"), ("root", "<u8")])
#: A text and one that may be near it, by bits of their fingerprints.
NEAR = np.dtype([("a", "<u8"), ("b", "<u8"), ("bits", "u1")])
#: A pair of texts, the sizes of their sets, and how many shingles their prefixes share.
SHARED = np.dtype([("a", "<u8"), ("b", "<u8"), ("n", "<u4"), ("m", "<u4"), ("count", "<u4")])
#: Neighbours on either side that are looked at in each order of fingerprints, and bits by which these are rotated.
WINDOW, TURNS = 6, (0, 16, 32, 48)
#: Bytes of entries in a bucket: as many as there are partitions, if these hold the least; beyond the most, more.
LEAST_BUCKET, MOST_BUCKET = 1 << 21, 1 << 25
#: Pairs that a task makes at once, and holds before it counts and sends them.
PAIRS_AT_ONCE, PAIRS_HELD = 250_000, 1_000_000


def fitting(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the sets of these entries, if they first meet here, can have a Jaccard similarity of `least`."""
    n, m = a["n"].astype(np.int64), b["n"].astype(np.int64)
    after = np.minimum(n - a["i"], m - b["i"])
    return after * (1 + least) >= (n + m) * least - 1e-6


def prefix_entries(texts: Iterable[bytes], size: int, common: np.ndarray, least: float) -> np.ndarray:
    """The ENTRYs of the prefixes of some texts, each different text once."""
    out, seen = [], set()
    for raw in texts:
        key = text_key(raw)
        if key not in seen:
            seen.add(key)
            whole = shingle_set(raw, size)
            first = prefix(whole, common, least)
            found = np.empty(len(first), ENTRY)
            found["s"], found["key"], found["n"], found["i"] = first, key, len(whole), np.minimum(np.arange(len(first)), 65535)
            out.append(found)
    return np.concatenate(out) if out else np.empty(0, ENTRY)


def grouped(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries by shingle and text, each text once and only shingles of two texts or more; bounds of the shingles)."""
    entries = entries[np.lexsort((entries["key"], entries["s"]))]
    if len(entries):
        again = np.concatenate([[False], (entries["s"][1:] == entries["s"][:-1]) & (entries["key"][1:] == entries["key"][:-1])])
        entries = entries[~again]
        same = entries["s"][1:] == entries["s"][:-1]
        entries = entries[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    if not len(entries):
        return entries, np.zeros(1, np.int64)
    new = np.flatnonzero(np.concatenate([[True], entries["s"][1:] != entries["s"][:-1]]))
    return entries, np.append(new, len(entries))


def _starts(entries: np.ndarray, name: str) -> np.ndarray:
    """Whether an entry begins a new run of this field."""
    return np.concatenate([[True], entries[name][1:] != entries[name][:-1]]) if len(entries) else np.zeros(0, bool)


def several_roots(entries: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same without shingles whose texts are all of one root."""
    if not len(entries):
        return entries, bounds
    sizes = np.diff(bounds)
    apart = np.minimum.reduceat(entries["root"], bounds[:-1]) != np.maximum.reduceat(entries["root"], bounds[:-1])
    return entries[np.repeat(apart, sizes)], np.concatenate([[0], np.cumsum(sizes[apart])])


def sizes_fit(n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    return np.minimum(n, m) >= least * np.maximum(n, m) - 1e-6


def best(found: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of each text, from NEARs."""
    found = np.unique(found)
    found = found[np.lexsort((found["b"], found["bits"], found["a"]))]
    starts = np.flatnonzero(_starts(found, "a"))
    return found[np.arange(len(found)) - np.repeat(starts, np.diff(np.append(starts, len(found)))) < k]


def nearest(entries: np.ndarray, least: float, k: int) -> np.ndarray:
    """For each text up to k texts of other roots that share a shingle with it, by bits of their fingerprints.

    Neighbours in the orders of the rotated fingerprints are looked at, so the cost is in proportion to the
    entries; it is a first choice only.
    """
    out = [np.empty(0, NEAR)]
    for turn in TURNS:
        turned = entries["fp"] << np.uint64(turn) | entries["fp"] >> np.uint64(64 - turn) if turn else entries["fp"]
        rows = entries[np.lexsort((turned, entries["s"]))]
        for step in range(1, min(WINDOW + 1, len(rows))):
            x, y = rows[:-step], rows[step:]
            good = (x["s"] == y["s"]) & (x["root"] != y["root"])
            x, y = x[good], y[good]
            good = fitting(x, y, least) & sizes_fit(x["n"], y["n"], least)
            x, y = x[good], y[good]
            for a, b in ((x, y), (y, x)):
                near = np.empty(len(a), NEAR)
                near["a"], near["b"], near["bits"] = a["key"], b["key"], np.bitwise_count(a["fp"] ^ b["fp"])
                out.append(near)
        out = [best(np.concatenate(out), k)]
    return out[0]


def shared(entries: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """SHAREDs of all pairs of texts of different roots that share a shingle, if their sizes fit; counts are of these entries."""
    entries = entries[np.lexsort((entries["root"], entries["s"]))]
    if not len(entries):
        return
    at = np.arange(len(entries))
    group = np.maximum.accumulate(np.where(_starts(entries, "s"), at, 0))
    run = np.maximum.accumulate(np.where(_starts(entries, "s") | _starts(entries, "root"), at, 0))
    # Each entry with those of its shingle that stand before the run of its root.
    total = np.concatenate([[0], np.cumsum(run - group)])
    key, n = entries["key"], entries["n"]
    out, held, k = [], 0, 0
    while k < len(entries):
        end = max(k + 1, int(np.searchsorted(total, total[k] + PAIRS_AT_ONCE, "right")) - 1)
        for mine, theirs in _before(group[k:end], run[k:end], k):
            good = sizes_fit(n[mine], n[theirs], least)
            mine, theirs = mine[good], theirs[good]
            swap = key[mine] > key[theirs]
            a, b = np.where(swap, theirs, mine), np.where(swap, mine, theirs)
            found = np.empty(len(a), SHARED)
            found["a"], found["b"], found["n"], found["m"], found["count"] = key[a], key[b], n[a], n[b], 1
            out.append(found)
            held += len(found)
        k = end
        if held > PAIRS_HELD:
            out = [counted(np.concatenate(out))]
            held = len(out[0])
            if held > PAIRS_HELD // 2:
                yield out[0]
                out, held = [], 0
    if held:
        yield counted(np.concatenate(out))


def _before(low: np.ndarray, high: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the entries from k on, each with those in its range low .. high, in parts of PAIRS_AT_ONCE (one range may be longer than that)."""
    if len(low) == 1:
        for begin in range(int(low[0]), int(high[0]), PAIRS_AT_ONCE):
            theirs = np.arange(begin, min(begin + PAIRS_AT_ONCE, int(high[0])))
            yield np.full(len(theirs), k), theirs
        return
    counts = high - low
    mine = np.repeat(np.arange(len(low)), counts)
    yield mine + k, np.arange(len(mine)) - np.repeat(np.cumsum(counts) - counts, counts) + low[mine]


def counted(found: np.ndarray) -> np.ndarray:
    """SHAREDs with the counts of each pair summed up."""
    found = found[np.lexsort((found["b"], found["a"]))]
    starts = np.flatnonzero(_starts(found, "a") | _starts(found, "b"))
    out = found[starts]
    out["count"] = np.add.reduceat(found["count"], starts) if len(starts) else 0
    return out


def enough(found: np.ndarray, least: float) -> np.ndarray:
    """Whether sets whose prefixes share so many shingles can have a Jaccard similarity of `least`.

    Of the set whose prefix ends first in the common order, all shared elements up to there are in both
    prefixes, so the overlap is at most their count and what this set has after its prefix.
    """
    n, m = found["n"].astype(np.int64), found["m"].astype(np.int64)
    after = np.maximum(*(np.ceil(least * x - 1e-9).astype(np.int64) - 1 for x in (n, m)))
    return (found["count"] + after) * (1 + least) >= (n + m) * least - 1e-6


class PrefixJoin:
    """Pairs of texts whose sets of `size`-word shingles can have a Jaccard similarity of `least`, by an exact prefix filter.

    Two such sets share a shingle of their prefixes, and more of them the longer they are.  The prefixes'
    entries travel as packed records dealt out by shingle, equal texts as one; shingles of one text end there.
    """

    def __init__(self, texts: DataFrame, size: int, common: np.ndarray, least: float, words: int):
        """texts: t; words: how many words they hold in all (which sets the number of buckets)."""
        tasks = partitions(texts.sparkSession)
        # Each task makes a record for each bucket: their number follows the entries, not the session's partitions alone.
        size_of_all = int(words * (1 - least)) * ENTRY.itemsize
        self.least, buckets = least, max(1, min(tasks, size_of_all // LEAST_BUCKET), size_of_all // MOST_BUCKET)
        self.buckets, self.tasks = buckets, max(tasks, buckets)

        def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "t", 1 << 23):
                yield _dealt(1, prefix_entries(raw_values(batch.column("t")), size, common, least), "s", buckets)

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield _dealt(1, grouped(gather(batches, ENTRY))[0], "key", buckets)

        self.settled = cut(texts.select("t").mapInArrow(returning(enter), RECORD).repartition(self.tasks, "bucket").mapInArrow(returning(settle), RECORD))
        release(texts.sparkSession)

    def _rooted(self, nodes: DataFrame) -> DataFrame:
        """The settled entries, dealt by shingle, with fp and root of their texts; nodes: key, fp, root."""
        buckets = self.buckets

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = np.empty(batch.num_rows, NODE)
                for name in NODE.names:
                    found[name] = batch.column(name).to_numpy().view(np.uint64)
                yield _dealt(2, found, "key", buckets)

        def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            both = list(batches)
            entries, known = (gather([b.filter(pa.compute.equal(b.column("kind"), kind)) for b in both], of) for kind, of in ((1, ENTRY), (2, NODE)))
            if len(entries):
                known = known[np.argsort(known["key"])]
                out = np.empty(len(entries), ROOTED)
                at = np.searchsorted(known["key"], entries["key"])
                for name in ROOTED.names:
                    out[name] = entries[name] if name in ENTRY.names else known[name][at]
                yield _dealt(1, out, "s", buckets)

        return self.settled.union(nodes.select(*NODE.names).mapInArrow(returning(send), RECORD)).repartition(self.tasks, "bucket").mapInArrow(returning(attach), RECORD).repartition(self.tasks, "bucket")

    def near(self, nodes: DataFrame, k: int) -> DataFrame:
        """(a, b): up to k near texts of other roots for each text; from here on, shingles of one root are left out."""
        buckets, least = self.buckets, self.least

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            entries, _ = several_roots(*grouped(gather(batches, ROOTED)))
            yield _dealt(0, nearest(entries, least, k), "a", buckets)
            rest = np.empty(len(entries), ENTRY)
            for name in ENTRY.names:
                rest[name] = entries[name]
            yield _dealt(1, rest, "key", buckets)

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _rows(best(gather(batches, NEAR), k))

        found = cut(self._rooted(nodes).mapInArrow(returning(settle), RECORD))
        self.settled = found.where("kind = 1")
        release(found.sparkSession)
        return found.where("kind = 0").repartition(self.tasks, "bucket").mapInArrow(returning(choose), "a long, b long")

    def rest(self, nodes: DataFrame, k: int | None = None) -> DataFrame:
        """(a, b): all pairs of texts of different roots that can be similar enough; with k: for each text the k that share most."""
        buckets, least = self.buckets, self.least

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in shared(several_roots(*grouped(gather(batches, ROOTED)))[0], least):
                yield _dealt(0, found, "a", buckets)

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = counted(gather(batches, SHARED))
            found = found[enough(found, least)]
            if k is None:
                yield from _rows(found)
                return
            # Each end chooses among its pairs.
            turned = found.copy()
            turned["a"], turned["b"] = found["b"], found["a"]
            yield _dealt(0, np.concatenate([found, turned]), "a", buckets)

        def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = gather(batches, SHARED)
            found = found[np.lexsort((found["b"], -found["count"].astype(np.int64), found["a"]))]
            starts = np.flatnonzero(_starts(found, "a"))
            yield from _rows(found[np.arange(len(found)) - np.repeat(starts, np.diff(np.append(starts, len(found)))) < k])

        pairs = self._rooted(nodes).mapInArrow(returning(settle), RECORD).repartition(self.tasks, "bucket")
        if k is None:
            return pairs.mapInArrow(returning(choose), "a long, b long")
        return pairs.mapInArrow(returning(choose), RECORD).repartition(self.tasks, "bucket").mapInArrow(returning(most), "a long, b long")


RECORD = "kind int, bucket long, blob binary"


def _rows(found: np.ndarray) -> Iterator[pa.RecordBatch]:
    return in_parts(found, 50_000, lambda p: pa.RecordBatch.from_arrays([pa.array(p[c].astype(np.uint64).view(np.int64)) for c in "ab"], ["a", "b"]))


def _dealt(kind: int, records: np.ndarray, by: str, buckets: int) -> pa.RecordBatch:
    bucket, blob = deal((mix(records[by]) % np.uint64(buckets)).astype(np.int64), records, buckets)
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(bucket), pa.int32()), bucket, blob], ["kind", "bucket", "blob"])


def text_key(raw: bytes) -> int:
    """The key of a text as an unsigned number: what F.xxhash64 gives for the string."""
    import xxhash

    return xxhash.xxh64_intdigest(raw, SEED)


def common_shingles(df: DataFrame, size: int, n: int) -> np.ndarray:
    """Sorted hashes of the shingles that occur in MIN_COMMON texts or more of a bounded sample of the n texts (t), the most common MAX_COMMON."""
    sample = df.where(F.pmod(F.xxhash64(F.xxhash64("t")), F.lit(max(1, n // SAMPLE))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 1 << 22):
            raws = set(raw_values(batch.column("t")))
            sets = [shingle_set(raw, size) for raw in raws] or [np.empty(0, np.uint64)]
            keys = np.repeat(np.array([text_key(raw) for raw in raws], np.uint64), [len(s) for s in sets] if raws else [])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(keys.view(np.int64))], ["s", "key"])

    counts = sample.mapInArrow(run, "s long, key long").distinct().groupBy("s").count().where(F.col("count") >= MIN_COMMON)
    return np.sort(np.array([r.s for r in counts.orderBy(F.desc("count"), "s").limit(MAX_COMMON).collect()], np.int64).view(np.uint64))


def drop_near_copies(df: DataFrame, *, distance: int = 3, shingle: int = 3, verify_words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df but for near copies: of each group the document of the least id stays.

    Groups are the components of equal texts and of texts whose sets of `verify_words`-word shingles have a
    Jaccard similarity of `least` or more, however far their fingerprints are apart.  Candidates come in three
    rounds, and each candidate is compared by the whole sets of its texts:

    1. texts of fingerprints that joining_links joins (of one fingerprint, each text with the first one), and
       of the texts that share a shingle of their prefixes (PrefixJoin) the NEAREST by their fingerprints;
    2. for each text more of the nearest of other components by their fingerprints, and then those of other
       components whose prefixes share most with its own;
    3. all pairs of the prefix filter that stand in different components by then.  As every pair of this
       similarity passes the filter, no link between groups is missed; rounds 1 and 2 cost a few pairs for
       each member of a crowd, and leave few to the last.

    Rows of a null id stay; a null text counts as empty, and texts without words are alike; fully repeated
    rows are one document and stay or go together; of an id with several texts each text is judged for
    itself; an empty table gives an empty result; other columns, whatever their names, stay as they are.
    """
    named = df.where(col(id_col).isNotNull()).select(col(id_col).cast("long").alias("doc"), F.coalesce(col(text_col), F.lit("")).alias("t"))
    marked = cut(_prints(named, shingle))
    texts = cut(marked.groupBy("key").agg(F.min("doc").alias("doc"), F.min_by("md5", F.struct("doc", "md5")).alias("md5"), F.min("fp").alias("fp"), F.max("words").alias("words")))
    n, words = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0))).first()
    heads = cut(texts.groupBy("fp").agg(F.min("key").alias("name")))
    across = joining_links(heads, distance).select("a", "b")
    within = texts.select("fp", F.col("key").alias("b")).join(heads, "fp").where("name <> b").select(F.col("name").alias("a"), "b")
    join = PrefixJoin(named, verify_words, common_shingles(named, verify_words, n), least, words)
    nodes = texts.select("key", "fp", F.col("key").alias("root"))
    first = across.union(within).union(join.near(nodes, NEAREST))
    compared, edges = _alike(first, None, texts, named, verify_words, least)
    del heads, across, within, first, nodes
    release(df.sparkSession)
    for later in (lambda nodes: join.near(nodes, 2 * NEAREST), lambda nodes: join.rest(nodes, 4 * NEAREST), join.rest):
        # Contracted links stand for all links so far.
        edges = contracted(edges, 2)
        known = roots(edges)
        nodes = cut(texts.join(known, texts["key"] == known["node"], "left").select("key", "fp", F.coalesce("root", "key").alias("root")))
        more, found = _alike(later(nodes), compared, texts, named, verify_words, least)
        compared, edges = compared.union(more), edges.union(found)
        del nodes, known, more, found
        release(df.sparkSession)
    known = connected_components(edges)
    rooted = texts.join(known, texts["key"] == known["node"], "left").select("key", "doc", "md5", F.coalesce("root", "key").alias("root"))
    best = cut(rooted.groupBy("root").agg(F.min(F.struct("doc", "key")).alias("best")))
    classes = cut(rooted.join(best, "root").select("key", "md5", F.col("best.doc").alias("stay"), F.col("best.key").alias("as")))
    # Two texts of one key (a collision of 64 bits) are told apart by their digests: the other one stays.
    gone = marked.join(classes.withColumnRenamed("md5", "own"), "key").where("md5 = own AND (doc <> stay OR key <> as)").select("doc", "key")
    lost = small(cut(gone.distinct()))
    here = F.xxhash64(F.coalesce(df[f"`{text_col}`"], F.lit("")))
    return df.join(lost, (df[f"`{id_col}`"].cast("long") == lost["doc"]) & (here == lost["key"]), "left_anti")


def _alike(pairs: DataFrame, known: DataFrame | None, texts: DataFrame, named: DataFrame, words: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Of the pairs (a, b) of keys that are not known: all, and (u, v) of those whose texts are similar enough, by their whole sets of shingles."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = cut(pairs if known is None else pairs.join(known, ["a", "b"], "left_anti"))
    release(texts.sparkSession)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = small(cut(texts.join(needed, "key", "left_semi").select("key", "doc")))
    bodies = cut(named.withColumn("key", F.xxhash64("t")).join(wanted, ["key", "doc"], "left_semi").select("key", "t").groupBy("key").agg(F.first("t").alias("t")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x", 1 << 23):
            good = [similarity(shingle_set(x, words), shingle_set(y, words)) >= least for x, y in zip(raw_values(batch.column("x")), raw_values(batch.column("y")))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    release(texts.sparkSession)
    left, right = bodies.select(F.col("key").alias("a"), F.col("t").alias("x")), bodies.select(F.col("key").alias("b"), F.col("t").alias("y"))
    return pairs, cut(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(returning(verify), "u long, v long"))


def _prints(df: DataFrame, shingle: int) -> DataFrame:
    """doc, fp, key and md5 of the text, and its number of words; df: doc, t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in slices(batches, "t", 1 << 23):
            rows = []
            for raw in raw_values(batch.column("t")):
                words = raw.lower().split()
                rows.append((fingerprint_of(words, shingle), text_key(raw), hashlib.md5(raw).digest(), len(words)))
            fp, key, digest, count = zip(*rows)
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fp, key)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *longs, pa.array(digest, pa.binary()), pa.array(count, pa.int64())], ["doc", "fp", "key", "md5", "words"])

    return df.mapInArrow(returning(run), "doc long, fp long, key long, md5 binary, words long")
