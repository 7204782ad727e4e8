"""URL filters: host words by unigram Viterbi, verdicts by rules and multinomial naive Bayes.

Words and their counts come from the texts of the pages. Host names are cut at dots, hyphens and
digits into pieces; each distinct piece is joined, by its substrings, with the words, and the most
likely split under the unigram counts is kept. Segmented host words and path tokens are the features
of a naive Bayes model learned from the pages that a rule judges; it judges the others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.store import stored


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the production query. A rule fits its host and all subdomains.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

#: Where markup may begin; an element whose content is no text, and what ends it.
_BEGIN = re.compile(r"<|&[a-z]+;", re.IGNORECASE)
_ELEMENT = re.compile(r"<(?:(script)|(style))\b", re.IGNORECASE)
_ENDS = [re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style")]
_WORD = re.compile(r"[^\W\d_]+")
_BUCKETS = 1 << 18


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """``(page_id, host, path)``: what follows the first ``://``, A-Z of the host in lower case."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract("rest", r"\A([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select(F.col("page_id").cast("long"), F.coalesce(rest, F.lit("")).alias("rest")).select(
        "page_id", lowered.alias("host"), F.regexp_extract("rest", r"\A[^/?#]*([^?#]*)", 1).alias("path")
    )


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the longest is tried first: it is wrapped last
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def without_markup(html: str) -> str:
    """``html`` with a space for each script or style element, comment, tag and entity. What is not closed is text, but
    for its tag, if that is. One scan: an end that is not found is not looked for again."""
    out, done, at, missing = [], 0, 0, set()

    def after(kind: int | str, start: int) -> int:
        """The place after the next end of that kind, or 0."""
        if kind in missing:
            return 0
        if isinstance(kind, int):
            found = _ENDS[kind].search(html, start)
            place = found.end() if found else 0
        else:
            found = html.find(kind, start)
            place = found + len(kind) if found >= 0 else 0
        if not place:
            missing.add(kind)
        return place

    while begin := _BEGIN.search(html, at):
        start, at = begin.span()
        if html[start] == "<":
            element = _ELEMENT.match(html, start)
            end = element and after(0 if element[1] else 1, element.end())
            end = end or (html.startswith("<!--", start) and after("-->", start + 4)) or after(">", start + 1)
            if not end:
                continue
            at = end
        out += [html[done:start], " "]
        done = at
    out.append(html[done:])
    return "".join(out)


def page_words(pages: DataFrame) -> DataFrame:
    """``(word, n)``: how often each word occurs in the texts of all pages, without case. Null and empty
    pages have none; repeated rows count each; an empty table gives an empty one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for html in batch.column(0).to_pylist():
                found.update(_WORD.findall(without_markup(html).lower()))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    found = pages.where("html is not null").select("html").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def best_split(piece: str, counts: dict[str, int], total: int) -> list[str]:
    """The split of a piece with the largest product of word chances. A word that is not known has the
    chance 1 / (total * 10^length): the longer, the less likely. Ties go to the longest last word.
    Linear in the piece, for each length that known words have."""
    ten, once, lengths = math.log(10.0), math.log(total), sorted({len(w) for w in counts}, reverse=True)
    best: list[tuple[float, int]] = [(0.0, 0)]
    unknown = (-math.inf, 0)  # the best split up to here that ends in an unknown word, and where that begins
    for end in range(1, len(piece) + 1):
        unknown = max((unknown[0] - ten, unknown[1]), (best[end - 1][0] - once - ten, end - 1), key=lambda x: (x[0], -x[1]))
        choices = [unknown]
        for length in lengths:
            start = end - length
            if start >= 0 and (n := counts.get(piece[start:end], 0)):
                choices.append((best[start][0] + math.log(n) - once, start))
        best.append(max(choices, key=lambda x: (x[0], -x[1])))
    words, end = [], len(piece)
    while end:
        start = best[end][1]
        words.append(piece[start:end])
        end = start
    return words[::-1]


def _substrings(lengths: list[int]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.column(0).to_pylist():
                for length in lengths:  # one length at a time: as many rows as the piece has letters, at most
                    own = list({piece[i : i + length] for i in range(len(piece) - length + 1)})
                    if own:
                        yield pa.RecordBatch.from_arrays([pa.array([piece] * len(own), pa.string()), pa.array(own, pa.string())], ["piece", "word"])

    return cut


def host_words(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """``(host, words array<string>)`` for distinct ``hosts(host)``: the words of all its pieces (runs of
    letters). An empty host, or one without letters, has no row; without any words each piece is one."""
    total = max(words.agg(F.sum("n")).first()[0] or 0, 1)
    lengths = sorted(r[0] for r in words.select(F.length("word")).distinct().collect())  # fewer than the longest word has letters
    pieces_of = F.filter(F.split(F.lower("host"), r"[^\p{L}\p{M}]+"), lambda p: p != "")
    placed = stored(hosts.select("host", F.posexplode(pieces_of).alias("at", "piece")), "pieces")
    pieces = placed.select("piece").distinct()
    known = pieces.mapInArrow(_substrings(lengths), "piece string, word string").join(words, "word")
    known = known.groupBy("piece").agg(F.collect_list(F.struct("word", "n")).alias("known"))  # substrings of one piece

    @F.pandas_udf("array<string>")
    def split(piece: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([best_split(p, {} if k is None else {x["word"]: x["n"] for x in k}, total) for p, k in zip(piece, known, strict=True)])

    told = pieces.join(known, "piece", "left").select("piece", split("piece", "known").alias("words"))
    joined = placed.join(told, "piece").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("parts"))  # pieces of one host
    return joined.select("host", F.flatten("parts.words").alias("words"))


def _tokens(words: Column, path: Column) -> Column:
    """Features: host words and path tokens apart, numbers as one token."""
    parts = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda p: p != "")
    parts = F.transform(parts, lambda p: F.when(p.rlike(r"\A[0-9]+\z"), F.lit("p:#")).otherwise(F.concat(F.lit("p:"), p)))
    return F.concat(F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w)), parts)


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, words, score)`` for each row of ``pages(page_id, url, html)``.

    ``rule`` is the name of the longest rule that fits; its verdict holds. The others have the verdict
    of naive Bayes (Laplace smoothing; features hashed to 2**18 counts) learned from the pages with a
    rule; ``score`` is its log-odds of block, allow at 0 and below. Without pages of both verdicts all
    other pages are allowed. A null url, or one without ``://``, has an empty host and path and no
    words. A null page_id stays null; repeated rows keep a row each; other columns are ignored; an
    empty table gives an empty result.
    """
    spark = pages.sparkSession
    urls = with_host_and_path(pages)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": name, "ruled": verdict})
    words = stored(page_words(pages), "page-words")
    split = stored(host_words(urls.select("host").distinct(), words), "host-words")
    urls = urls.join(split, "host", "left").withColumn("tokens", _tokens(F.col("words"), F.col("path")))

    bucket = F.pmod(F.xxhash64("token"), F.lit(_BUCKETS)).cast("int")
    taught = urls.where("ruled is not null").select("ruled", "tokens")
    pages_by = {r.ruled: r.n for r in taught.groupBy("ruled").agg(F.count("*").alias("n")).collect()}
    counts = (
        taught.select("ruled", F.explode("tokens").alias("token")).groupBy(bucket.alias("bucket"))
        .agg(F.count_if(F.col("ruled") == "block").alias("block"), F.count_if(F.col("ruled") == "allow").alias("allow")).toPandas()  # 2**18 rows at most
    )
    odds = np.zeros(_BUCKETS)
    prior = 0.0
    if pages_by.get("block") and pages_by.get("allow"):
        block, allow = np.zeros(_BUCKETS), np.zeros(_BUCKETS)
        block[counts["bucket"]], allow[counts["bucket"]] = counts["block"], counts["allow"]
        seen = int(((block + allow) > 0).sum()) + 1
        odds = np.log((block + 1) / (block.sum() + seen)) - np.log((allow + 1) / (allow.sum() + seen))
        odds[(block + allow) == 0] = 0.0  # a token that taught nothing tells nothing
        prior = math.log(pages_by["block"] / pages_by["allow"])
    weights = spark.sparkContext.broadcast(odds)

    @F.pandas_udf("double")
    def score(buckets: pd.Series) -> pd.Series:
        return pd.Series([prior + float(weights.value[np.asarray(b, np.int64)].sum()) if len(b) else 0.0 for b in buckets], dtype="float64")

    hashed = F.transform("tokens", lambda t: F.pmod(F.xxhash64(t), F.lit(_BUCKETS)).cast("int"))
    told = urls.withColumn("score", score(hashed))
    return told.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "words", "score"
    )
