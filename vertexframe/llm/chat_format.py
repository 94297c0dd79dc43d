r"""Chat formatting with offset-aligned loss masks.

A turn is rendered as `<turn ROLE>TEXT</turn>` and a newline, where in ROLE and TEXT a backslash is put
before every backslash, `<` and `>`.  An unescaped `<` therefore only ever begins a mark of the
template, whatever the texts hold, and parsing gives roles and texts back exactly.

A conversation is rendered whole and encoded once, with offsets (in bytes of its UTF-8: the tokens of a
byte-level vocabulary lie one after the other).  The spans of the texts of the trained-on roles (sorted,
disjoint) are intersected with the token spans (sorted) by binary search: the loss mask marks the tokens
that meet such a span, and the loss text is what these tokens cover of it.

Defined results: null text counts as empty, null role as the role `null`; turns are ordered by turn
(null first), then role and text, so repeated rows and ties stay and have a fixed order; an empty table
gives an empty result; other columns (of whatever name) are not read.  Rows of a conversation are
streamed in turn order out of Spark's external sort; only one rendered conversation is held at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, partitions, raw_values
from .packing import FastTokenizer, fast_tokenizer

_ESCAPES = str.maketrans({"\\": "\\\\", "<": "\\<", ">": "\\>"})


def escape(text: str) -> str:
    return text.translate(_ESCAPES)


def unescape(text: str) -> str:
    out, k = [], 0
    while (at := text.find("\\", k)) >= 0:
        out += [text[k:at], text[at + 1 : at + 2]]
        k = at + 2
    return "".join([*out, text[k:]])


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The rendered conversation and, for each turn, its role and where the bytes of its escaped text lie."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<turn {escape(role)}>", escape(text)
        parts += [head, body, "</turn>\n"]
        begin = at + len(head.encode())
        end = begin + len(body.encode())
        spans.append((role, begin, end))
        at = end + 8
    return "".join(parts), spans


def _bare(text: str, char: str, at: int) -> int:
    """The first unescaped char at or after a place that is not inside an escape."""
    while True:
        hit, slash = text.find(char, at), text.find("\\", at)
        if slash < 0 or hit < slash:
            return hit
        at = slash + 2


def parse(rendered: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered conversation."""
    turns, at = [], 0
    while at < len(rendered):
        close = _bare(rendered, ">", at)
        end = _bare(rendered, "<", close + 1)
        turns.append((unescape(rendered[at + 6 : close]), unescape(rendered[close + 1 : end])))
        at = end + 8
    return turns


def loss_pieces(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Mask over tokens and the covered places, by binary search of sorted spans in sorted tokens."""
    mask = np.zeros(len(starts), bool)
    pieces: list[tuple[int, int]] = []
    begins, stops = (np.array(x, np.int64) for x in (zip(*spans) if spans else ((), ())))
    firsts, lasts = np.searchsorted(ends, begins, "right"), np.searchsorted(starts, stops, "left")
    for begin, end, first, last in zip(begins.tolist(), stops.tolist(), firsts.tolist(), lasts.tolist()):
        if begin == end or first >= last:
            continue
        mask[first:last] = True
        s, e = np.maximum(starts[first:last], begin), np.minimum(ends[first:last], end)
        gaps = np.flatnonzero(s[1:] > np.maximum.accumulate(e)[:-1]) + 1
        bounds = [0, *gaps.tolist(), len(s)]
        pieces += [(int(s[a]), int(e[a:b].max())) for a, b in zip(bounds, bounds[1:])]
    return mask, pieces


def format_one(turns: list[tuple[str, str]], tokenizer: FastTokenizer, trained: frozenset) -> tuple[str, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Rendered conversation, token ids, loss mask, loss spans."""
    rendered, spans = render(turns)
    ids = tokenizer.plain_ids(rendered)  # special strings inside texts are ordinary text
    ends = np.cumsum(tokenizer.sizes[ids])
    mask, pieces = loss_pieces([(s, e) for role, s, e in spans if role in trained], ends - tokenizer.sizes[ids], ends)
    return rendered, ids, mask, pieces


RESULT = "formatted string, token_ids array<int>, loss_mask array<boolean>, loss_spans array<struct<start: long, end: long>>"


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat, kind))


def format_conversations(
    df: DataFrame, tokenizer_file: str, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """id, formatted, token_ids, loss_mask, loss_spans (in bytes of formatted) for each conversation."""
    rows = df.select(col(id_col).alias("id"), col(turn_col).alias("turn"), F.coalesce(col(role_col), F.lit("null")).alias("role"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    trained = frozenset(trained_roles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = fast_tokenizer(tokenizer_file)
        current, turns, out, size = None, [], [], 0
        id_field = None

        def flush() -> pa.RecordBatch:
            spans = pa.array([[{"start": s, "end": e} for s, e in pieces] for _, (_, _, _, pieces) in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            columns = [pa.array([i for i, _ in out], id_field), pa.array([r[0] for _, r in out], pa.string()), _lists([r[1].astype(np.int32) for _, r in out], pa.int32()), _lists([r[2] for _, r in out], pa.bool_()), spans]
            return pa.RecordBatch.from_arrays(columns, ["id", "formatted", "token_ids", "loss_mask", "loss_spans"])

        for batch in batches:
            id_field = batch.schema.field("id").type
            for key, role, text in zip(batch.column("id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if turns and key != current:
                    out.append((current, format_one(turns, tokenizer, trained)))
                    size += len(out[-1][1][0])
                    turns = []
                    if size > 2_000_000:
                        yield flush()
                        out, size = [], 0
                current = key
                turns.append((role, text))
        if turns:
            out.append((current, format_one(turns, tokenizer, trained)))
        if out:
            yield flush()

    dealt = rows.repartition(partitions(df.sparkSession), "id").sortWithinPartitions("id", "turn", "role", "text")
    return dealt.select("id", "role", "text").mapInArrow(run, f"id {id_type}, {RESULT}").withColumnRenamed("id", id_col)


def read_back(df: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """Digests of what the formatted conversations hold: turns by parsing, loss text by the spans of the loss mask."""
    base = df.select(
        col(id_col).alias("id"), "formatted", "loss_spans", F.size("token_ids").cast("long").alias("n_tokens"), F.size(F.filter("loss_mask", lambda x: x)).cast("long").alias("loss_tokens")
    )
    id_type = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"n_turns": [], "turns_sha256": [], "loss_chars": [], "loss_sha256": [], "formatted_chars": []}
            for raw, spans in zip(raw_values(batch.column("formatted")), batch.column("loss_spans").to_pylist()):
                text = raw.decode()
                turns = parse(text)
                loss = "".join(unescape(raw[s["start"] : s["end"]].decode()) for s in spans)
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            added = [pa.array(v, pa.string() if "sha" in k else pa.int64()) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *added, batch.column("n_tokens"), batch.column("loss_tokens")], ["id", *out, "n_tokens", "loss_tokens"])

    found = base.mapInArrow(run, f"id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")
    return found.withColumnRenamed("id", id_col)
