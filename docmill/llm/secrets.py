"""Secret scans through a trigram inverted index.

Each rule is a regular expression. From its parse a Boolean trigram query is derived: a tree of AND
and OR over trigrams that any match must contain. Documents are indexed in shards (the documents
of one slice of a partition): the index maps each trigram that some rule asks for to its posting
list. Queries are answered by intersecting and uniting postings, and only the candidates are
verified with the regular expression, over their whole text. A rule without a mandatory trigram
scans all texts. The shards live where the texts are, so no text is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as K
from re import _parser as P

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.text import slices


@dataclass(frozen=True)
class Rule:
    """``minimum``: matches whose ``group`` is shorter are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    minimum: int = 0


#: Base rules, in the order in which kinds break ties, then the rules that the index makes cheap.
BASE_RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"(?ai:bearer)\x20+([A-Za-z0-9._~+/-]{20,}=*)"),
    Rule("userinfo", r"[a-z][a-z0-9+.-]{2,20}://[^\s/:@]{1,64}:([^\s/:@]{6,64})@"),
)
RULES = BASE_RULES + MORE_RULES

# A trigram query: True (all texts), ("and", parts) or ("or", parts) or a trigram.
_MOST_STRINGS = 24


def _and(parts: list) -> object:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_string(s: str) -> object:
    return _and([s[i : i + 3] for i in range(len(s) - 2)])


def _letters(items: list) -> list[str] | None:
    """The lower-case characters of a set, if they are few and ASCII."""
    out: list[str] = []
    for op, arg in items:
        if op is K.LITERAL:
            out.append(chr(arg).lower())
        elif op is K.RANGE and arg[1] - arg[0] < 8:
            out += [chr(c).lower() for c in range(arg[0], arg[1] + 1)]
        else:
            return None
    return list(dict.fromkeys(out)) if len(set(out)) <= 8 else None


def trigram_query(pattern: str) -> object:
    """What the lower-case text must contain for the pattern to match it."""

    def walk(seq) -> tuple[list[str] | None, object]:
        """(all strings that it matches, if few; query of what precedes them)."""
        exact: list[str] | None = [""]
        done: list = []

        def close(strings: list[str] | None) -> None:
            if strings:
                done.append(_or([_of_string(s) for s in strings]))

        for op, arg in seq:
            part: list[str] | None = None
            if op is K.LITERAL:
                part = [chr(arg).lower()]
            elif op is K.IN:
                part = _letters(arg)
            elif op is K.SUBPATTERN:
                part, query = walk(arg[3])
                if part is None:
                    done.append(query)
            elif op is K.BRANCH:
                branches = [walk(x) for x in arg[1]]
                if all(b[0] is not None for b in branches):
                    part = list(dict.fromkeys(s for b in branches for s in b[0]))
                else:
                    done.append(_or([b[1] if b[0] is None else _or([_of_string(s) for s in b[0]]) for b in branches]))
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
                low, high, body = arg
                inner, query = walk(body)
                if inner is not None and high == 1:
                    part = [*([""] if low == 0 else []), *inner]
                elif inner is not None and low == high and low <= 8 and len(inner) == 1:
                    part = [inner[0] * low]
                elif low >= 1:
                    done.append(query if inner is None else _or([_of_string(s) for s in inner]))
            elif op is K.AT:
                continue
            if part is not None and exact is not None and len(exact) * len(part) <= _MOST_STRINGS:
                exact = [a + b for a in exact for b in part]
            elif part is not None:
                close(exact)
                exact = part
                done.append(True)
            else:
                close(exact)
                exact = None
        if not done and exact is not None and seq and all(op is not K.ANY for op, _ in seq):
            return exact, True
        close(exact)
        return None, _and(done)

    strings, query = walk(P.parse(pattern))
    return query if strings is None else _or([_of_string(s) for s in strings])


def trigrams_of(query: object) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else {t for p in query[1] for t in trigrams_of(p)}


def _code(trigram: str) -> int:
    a, b, c = trigram.encode("ascii")
    return a << 16 | b << 8 | c


class ShardIndex:
    """Postings of the wanted trigrams over the texts of one shard."""

    def __init__(self, texts: list[str], wanted: list[str]):
        # outside ASCII every character is '?'; rules whose trigrams hold no '?' lose nothing
        data = np.frombuffer("\0".join(texts).encode("ascii", "replace").lower(), np.uint8)
        begins = np.zeros(len(texts), np.int64)
        np.cumsum(np.fromiter((len(t) + 1 for t in texts[:-1]), np.int64, len(texts) - 1), out=begins[1:])
        codes = data[:-2].astype(np.int32)
        codes <<= 8
        codes |= data[1:-1] if len(data) > 2 else 0
        codes <<= 8
        codes |= data[2:] if len(data) > 2 else 0
        self.postings = np.zeros((len(wanted), len(texts)), bool)
        table = _lookup(tuple(wanted))
        place = np.flatnonzero(table[codes] >= 0)
        self.postings[table[codes[place]], np.searchsorted(begins, place, "right") - 1] = True
        self.row = {t: i for i, t in enumerate(wanted)}

    def answer(self, query: object) -> np.ndarray:
        if query is True:
            return np.ones(self.postings.shape[1], bool)
        if isinstance(query, str):
            return self.postings[self.row[query]]
        parts = [self.answer(p) for p in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


_tables: dict[tuple[str, ...], np.ndarray] = {}


def _lookup(wanted: tuple[str, ...]) -> np.ndarray:
    """Trigram code -> row of its postings, or -1."""
    if wanted not in _tables:
        table = np.full(1 << 23, -1, np.int16)
        for i, t in enumerate(wanted):
            table[_code(t)] = i
        _tables[wanted] = table
    return _tables[wanted]


def find_spans(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text the spans ``(start, end, place of the rule)``, in code points, sorted."""
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*(trigrams_of(q) for q in queries)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    index = ShardIndex(texts, wanted)
    for place, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        # whole runs of one set that are dropped when short are those of the minimum at least
        run = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
        pattern = re.compile(f"{run[1]}{{{rule.minimum},}}" if run and rule.group == 0 and rule.minimum else rule.pattern)
        for i in np.flatnonzero(index.answer(query)):
            for m in pattern.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.minimum:
                    out[i].append((m.start(), m.end(), place))
    for spans in out:
        spans.sort(key=lambda s: (s[0], s[2]))
    return out


def joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(doc_id, spans array<struct<kind, start, end>>)`` for each row of ``docs(doc_id, text)``.

    A null or empty text has no spans; a null doc_id stays null; repeated rows keep a row each; other
    columns are ignored; an empty table gives an empty result. Spans of different kinds may overlap.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for i, j in slices(texts):
                found = find_spans(texts[i:j], rules)
                rows = [[{"kind": rules[k].kind, "start": a, "end": b} for a, b, k in spans] for spans in found]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        scan, "doc_id long, spans array<struct<kind:string,start:int,end:int>>"
    )


def secret_report(docs: DataFrame) -> DataFrame:
    """The digest columns of each row: counts by base kind, SHA-256 of the base spans, all spans."""
    base = [r.kind for r in BASE_RULES]

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    return scan_secrets(docs).select(
        "doc_id", *[count(k) for k in base], F.sha2(text(own), 256).alias("base_sha256"), text(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows with every span replaced by ``mark`` (overlapping spans by one), ``n_chars`` if
    present as the new length. Rows without secrets, null and empty texts included, are unchanged;
    repeated rows change alike; other columns may have any names; an empty table gives an empty one."""
    schema = docs.schema
    at = docs.columns.index("text")
    sized = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(text: str, spans: list[tuple[int, int, int]]) -> str:
        parts, done = [], 0
        for a, b, _ in spans:
            if a >= done:
                parts += [text[done:a], mark]
            done = max(done, b)
        return "".join([*parts, text[done:]])

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            lengths = batch.column(sized).to_pylist() if sized is not None else []
            for i, j in slices(texts):
                for k, spans in enumerate(find_spans([t or "" for t in texts[i:j]], rules), i):
                    if spans:
                        texts[k] = clean(texts[k], spans)
                        if lengths:
                            lengths[k] = len(texts[k])
            arrays = list(batch.columns)
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            if lengths:
                arrays[sized] = pa.array(lengths, batch.schema.field(sized).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(change, schema)
