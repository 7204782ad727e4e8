"""Chat formatting with offset-aligned loss masks.

A conversation is rendered once as ``### role: text </turn>`` lines. Control strings inside roles
and texts are escaped with a backslash, so that reading the rendering back gives the turns again. The
rendering is encoded once with offsets. The sorted spans of the assistant texts are intersected with
the sorted token spans by binary search; a token may reach over the edge of a turn, so the mask
keeps, for each token, the part of its characters that lies inside.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, COLON, TAIL = "### ", ": ", " </turn>\n"
_ESCAPED = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ESCAPED_ROLE = re.compile(r"\\|#(?=##)|<(?=/turn>)|:")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_READ = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*) </turn>\n", re.DOTALL)

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def escape(text: str, role: bool = False) -> str:
    return (_ESCAPED_ROLE if role else _ESCAPED).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendering of (role, text) turns, and the spans of the assistant texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{HEAD}{escape(role, role=True)}{COLON}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, TAIL]
        at += len(head) + len(body) + len(TAIL)
    return "".join(parts), spans


def read_back(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendering."""
    turns, at = [], 0
    while at < len(rendered):
        m = _READ.match(rendered, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """``(token, start, end)``: what of each token lies in a span. Offsets and spans are sorted; several
    tokens may share one character."""
    out = [np.zeros((0, 3), np.int64)]
    for start, end in spans:
        first = int(np.searchsorted(offsets[:, 1], start, "right"))
        last = int(np.searchsorted(offsets[:, 0], end, "left"))
        token = np.arange(first, last)
        out.append(np.stack([token, np.maximum(offsets[first:last, 0], start), np.minimum(offsets[first:last, 1], end)], axis=1))
    return np.concatenate(out)


def masked_text(rendered: str, mask: np.ndarray) -> list[str]:
    """The text under a mask, as one string for each unbroken stretch, still escaped."""
    pieces, start, end = [], -1, -1
    for _, a, b in mask.tolist():
        if a > end or start < 0:
            if start >= 0:
                pieces.append(rendered[start:end])
            start, end = a, b
        else:
            end = max(end, b)
    if start >= 0:
        pieces.append(rendered[start:end])
    return pieces


_loaded: dict[str, object] = {}


def _tokenizer(name: str):
    """The tokenizer that was sent to the executors under this file name."""
    path = SparkFiles.get(name)
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # control strings of a tokenizer are ordinary text here
        _loaded[path] = tokenizer
    return _loaded[path]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Turns of one conversation after the other, from rows sorted by conversation and turn."""
    own, turns = object(), []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv is None or conv != own:
                if turns:
                    yield own, turns
                own, turns = conv, []
            turns.append((role or "", text or ""))
    if turns:
        yield own, turns


FORMATTED = "conv_id long, n_turns long, formatted string, token_ids array<int>, mask_tokens array<int>, mask_starts array<int>, mask_ends array<int>"


def format_conversations(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(conv_id, n_turns, formatted, token_ids, mask_tokens, mask_starts, mask_ends)``, one row for
    each conversation of ``rows(conv_id, turn, role, text)``.

    Rows are ordered by turn (null first), then role and text; repeated turns are kept. A null role or
    text is an empty one; each row without a conv_id is a conversation. Only the role ``assistant`` is
    under the mask. Other columns are ignored; an empty table gives an empty result. Rows are sorted
    inside partitions and read as a stream: one conversation at a time is in memory.
    """
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), *((n, pa.list_(pa.int32())) for n in ("token_ids", "mask_tokens", "mask_starts", "mask_ends"))]
    )

    rows.sparkSession.sparkContext.addFile(tokenizer)  # a vocabulary of some megabytes
    name = tokenizer.rsplit("/", 1)[-1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, waiting, size = _tokenizer(name), [], 0
        for conv, turns in _conversations(batches):
            rendered, spans = render(turns)
            encoding = encoder.encode(rendered, add_special_tokens=False)
            offsets = np.array(encoding.offsets, np.int64).reshape(-1, 2)
            mask = loss_mask(offsets, spans)
            waiting.append((conv, len(turns), rendered, encoding.ids, *mask.T.astype(np.int32)))
            size += len(rendered)
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*waiting, strict=True), schema, strict=True)], schema=schema)
                waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*waiting, strict=True), schema, strict=True)], schema=schema)

    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    own = F.coalesce("conv_id", F.xxhash64("turn", "role", "text"))
    return rows.repartition(own).sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(encode, FORMATTED)


def format_digests(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back from formatted conversations."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in ("formatted", "mask_tokens", "mask_starts", "mask_ends")}
            out: list[list] = [[], [], [], [], []]
            for rendered, *mask in zip(*c.values(), strict=True):
                turns = read_back(rendered)
                loss = "".join(unescape(p) for p in masked_text(rendered, np.array(mask, np.int64).reshape(3, -1).T))
                told = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                for column, value in zip(out, (len(turns), told, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(rendered)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
