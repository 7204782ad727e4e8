"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram binds its letters: their vectors, rotated
once for each place, are multiplied. A text bundles (sums) its n-grams, a language the texts that
teach it, and a text is given the language whose prototype has the largest cosine.

Bundling is linear, so each slice of texts binds every distinct n-gram once and bundles by a matrix
product of counts and n-gram vectors.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.text import _TABLE_SIZE, code_points, mix, slices

_U = np.uint64
_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code point -> lower-case letter or mark, else 0 (a word boundary)."""
    if not _LETTERS:
        table = np.zeros(_TABLE_SIZE, np.uint32)
        for cp in range(_TABLE_SIZE - 1):
            ch = chr(cp)
            if unicodedata.category(ch)[0] in "LM":
                table[cp] = ord(ch.lower()[0])
        _LETTERS.append(table)
    return _LETTERS[0]


def letter_vectors(letters: np.ndarray, dims: int) -> np.ndarray:
    """A +1/-1 vector for each letter, a fixed function of its code point; 0 is the boundary."""
    words = mix(mix(letters.astype(_U) + _U(0x9E3779B97F4A7C15))[:, None] + np.arange(1, dims // 64 + 1, dtype=_U))
    bits = np.unpackbits(words.view(np.uint8).reshape(len(letters), -1), axis=1)
    return (bits.astype(np.int8) * 2 - 1)[:, :dims]


def ngram_vectors(grams: np.ndarray, dims: int) -> np.ndarray:
    """Bound vectors of packed trigrams (21 bits a letter)."""
    letters = np.stack([grams >> _U(42), (grams >> _U(21)) & _U(0x1FFFFF), grams & _U(0x1FFFFF)])
    own, place = np.unique(letters, return_inverse=True)
    base = letter_vectors(own, dims)
    place = place.reshape(3, -1)
    out = np.roll(base, 2, axis=1)[place[0]]
    out *= np.roll(base, 1, axis=1)[place[1]]
    out *= base[place[2]]
    return out


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct letter trigrams of the texts: (text, packed trigram, occurrences). Runs of other
    characters are one boundary; trigrams around a boundary count, those across it do not."""
    # two boundaries around each text, so that no trigram spans two texts
    folded = _letter_table()[np.minimum(code_points("\0".join(["", *(t or "" for t in texts), ""])), _TABLE_SIZE - 1)]
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes) + 1
    keep = np.flatnonzero((folded != 0) | np.concatenate(([True], folded[:-1] != 0)))
    f = folded[keep].astype(_U)
    if len(f) < 3:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    gram = f[:-2] << _U(42) | f[1:-1] << _U(21) | f[2:]
    at = np.flatnonzero(f[1:-1] != 0)
    owner = np.searchsorted(ends, keep[1:-1][at], "right")
    order = np.argsort(gram[at], kind="stable")  # owners stay in order inside a trigram
    g, o = gram[at][order], owner[order]
    if not len(g):
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (o[1:] != o[:-1]))))
    return o[first], g[first], np.diff(np.concatenate((first, [len(g)])))


def bundles(texts: list[str | None], dims: int) -> np.ndarray:
    """``texts x dims``: the bundled trigram vectors of each text; zeros for one without letters."""
    owner, gram, count = _grams(texts)
    out = np.zeros((len(texts), dims), np.float32)
    if not len(gram):
        return out
    new = np.concatenate(([True], gram[1:] != gram[:-1]))
    own, column = gram[new], np.cumsum(new) - 1
    for a in range(0, len(own), 8192):  # bounded whatever the number of distinct trigrams
        b = min(a + 8192, len(own))
        part = slice(*np.searchsorted(column, (a, b)))
        dense = np.zeros((len(texts), b - a), np.float32)
        dense[owner[part], column[part] - a] = count[part]
        out += dense @ ngram_vectors(own[a:b], dims).astype(np.float32)
    return out


#: Word characters that are no digits, no underscores and no combining marks are looked at one by one.
_MAYBE = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a character of category L is in the text; marks alone make no text."""
    return any(unicodedata.category(m[0])[0] == "L" for m in _MAYBE.finditer(text or ""))


def prototypes(docs: DataFrame, dims: int = 1024, most_languages: int = 4096) -> tuple[list[str], np.ndarray]:
    """Language values and their bundles over all rows of ``docs(text, lang)`` that have both."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in slices(texts, limit=1 << 20, most=512):
                values, at = np.unique(np.array(langs[i:j], object), return_inverse=True)
                pooled = [[] for _ in values]
                for k, t in zip(at, texts[i:j], strict=True):
                    pooled[k].append(t)
                # bundling is linear: the texts of one language count as one text
                for lang, vector in zip(values, bundles([" ".join(p) for p in pooled], dims), strict=True):
                    sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["lang", "bundle"]
        )

    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    sums = rows.mapInArrow(bundle, "lang string, bundle array<double>")
    sums = sums.select("lang", F.posexplode("bundle").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    table = sums.limit(dims * (most_languages + 1)).toPandas()
    if len(table) > dims * most_languages:
        raise ValueError(f"more than {most_languages} values of lang")
    if not len(table):
        return [], np.zeros((0, dims))
    wide = table.pivot(index="lang", columns="at", values="value").sort_index()
    wide = wide[np.abs(wide.to_numpy()).sum(axis=1) > 0]
    return list(wide.index), wide.to_numpy()


def predict_language(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for each row of ``docs(doc_id, text)``, whole texts.

    score is the cosine with the prototype, 0 at least. A text that is null or has no letter is
    ``und`` with score 0, as is every text if nothing was learned. Ties go to the language that sorts
    first. A null doc_id stays null; repeated rows keep a row each; other columns are ignored; an
    empty table gives an empty result.
    """
    names, vectors = model
    dims = vectors.shape[1]
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    shared = docs.sparkSession.sparkContext.broadcast((np.array(names, object), unit.T.astype(np.float32)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, columns = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in slices(texts, limit=1 << 20, most=512):
                own = bundles(texts[i:j], dims)
                norm = np.linalg.norm(own, axis=1)
                told, value = np.full(j - i, "und", object), np.zeros(j - i)
                some = np.flatnonzero((norm > 0) & [has_letter(t) for t in texts[i:j]])
                if len(langs) and len(some):
                    cosine = (own[some] / norm[some, None]) @ columns
                    best = cosine.argmax(axis=1)
                    told[some] = langs[best]
                    value[some] = np.clip(cosine[np.arange(len(some)), best], 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(told, pa.string()), pa.array(value)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def language_report(docs: DataFrame, dims: int = 1024) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod 4 is not 2; predict all."""
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    model = prototypes(docs.where(~held), dims)
    return predict_language(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
