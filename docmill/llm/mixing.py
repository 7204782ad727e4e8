"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

The rows of a source are cut into blocks. A source of weight w gives its block j (from 0) a release
time floor(j / w) and a deadline ceil((j + 1) / w), in slots of one block, from the target weight
itself (whole numbers, nothing is rounded to a period); of the released blocks the one with the
earliest deadline comes next. So at every time a source has had less than one block more or less
than its share, until the first source ends; the others keep their proportions, and time leaps to
the next release where none is left to fill a slot.

The schedule has a row for each block: blocks grow with the table, so that there are no more than
``MOST_BLOCKS`` and one for each source, whatever the number of rows, and one fold can make it, which
looks at few sources for each block, however many there are. Ranks
inside a source are counted in hash buckets and summed, so that no task sorts a whole source.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docmill.llm.store import stored

#: Blocks have so many rows at least; the number of blocks, but for the last one of each source.
LEAST_BLOCK, MOST_BLOCKS = 8, 1 << 16
#: Blocks that are scheduled in one go.
_GO = 128


def _sources(docs: DataFrame, weights: Mapping[str, float] | None, block: int | None) -> DataFrame:
    """``(key, n, w, block, blocks)`` of each source: rows, weight as a whole number, rows of a block,
    number of blocks."""
    counts = docs.groupBy("key").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.floor(F.sqrt("n") * 1000)
    else:
        total = sum(max(float(v), 0.0) for v in weights.values()) or 1.0
        pairs = [F.lit(x) for k, v in weights.items() for x in (f"={k}", round(max(float(v), 0.0) / total * 10**12))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("key")] if pairs else F.lit(None), F.lit(0))
    size = F.lit(block) if block else F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sum("n").over(Window.partitionBy(F.lit(1))) / MOST_BLOCKS))  # a row for each source
    told = counts.select("key", "n", weight.cast("long").alias("w"), size.cast("long").alias("block"))
    return told.withColumn("blocks", F.expr("(n + block - 1) div block"))


def _schedule(sources: DataFrame) -> DataFrame:
    """``(key, turn, slot, start)``: for each block its slot and the place of its first row in the mixture.
    Sources without a weight come after all others, one after the other.

    Blocks are scheduled in goes of ``_GO``. A go looks at the next block of those sources only that it can
    reach, however many others wait: of blocks with one release time the ``_GO`` most urgent, and of releases those up
    to the last one that time can leap to, and a go further. The others are passed on as they are."""
    row = sources.where("w > 0").agg(F.array_sort(F.collect_list(F.struct("key", "w", "blocks", "n"))).alias("s"), F.max("block").alias("block"))
    row = row.select(F.col("s.key").alias("keys"), "s", "block", *(F.aggregate(f"s.{n}", F.lit(0).cast("long"), lambda a, x: a + x).alias(m) for n, m in (("w", "all"), ("blocks", "total"))))

    def let(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def block_of(done: Column, light: Column, i: Column, blocks: Column, n: Column) -> Column:
        """Release, deadline, weight and number of the next block of a source; ``light`` is the weight, negative."""
        release, deadline = (F.call_function("div", x, -light) for x in (done * F.col("all"), (done + 1) * F.col("all") - light - 1))
        return F.struct(release.alias("release"), deadline.alias("deadline"), light.alias("light"), i.alias("i"), done.alias("done"), blocks.alias("blocks"), n.alias("n"))

    def step(state: Column, _: Column) -> Column:
        def take(t: Column) -> Column:
            released = F.filter(state["open"], lambda x: x["release"] <= t)
            return let(
                F.array_min(F.transform(released, lambda x: F.struct(x["deadline"], x["light"], *(x[n].alias(n) for n in ("i", "done", "n"))))),
                lambda p: F.struct(
                    (t + 1).alias("now"), (state["rows"] + F.least(F.col("block"), p["n"] - p["done"] * F.col("block"))).alias("rows"),
                    F.filter(
                        F.transform(state["open"], lambda x: F.when(x["i"] == p["i"], block_of(x["done"] + 1, *(x[n] for n in ("light", "i", "blocks", "n")))).otherwise(x)),
                        lambda x: x["done"] < x["blocks"],
                    ).alias("open"),
                    F.concat(state["turns"], F.array(F.struct(p["i"].alias("i"), p["done"].alias("turn"), t.alias("slot"), state["rows"].alias("start")))).alias("turns"),
                ),
            )

        return let(F.greatest(state["now"], F.array_min(F.transform(state["open"], lambda x: x["release"]))), take)

    zero = F.lit(0).cast("long")
    none = F.filter(F.array(F.struct(F.lit(0).alias("i"), zero.alias("turn"), zero.alias("slot"), zero.alias("start"))), lambda _: F.lit(False))

    def go(state: Column, k: Column) -> Column:
        def reached(blocks: Column, at: Column) -> Column:
            x, before = F.get(blocks, at), F.get(blocks, at - _GO)
            return (at < _GO) | (x["release"] <= F.get(blocks, F.lit(_GO))["release"] + _GO) & (before["release"] < x["release"])

        def run(blocks: Column) -> Column:
            steps = F.sequence(F.lit(1).cast("long"), F.least(F.lit(_GO).cast("long"), F.col("total") - k * _GO))
            start = F.struct(state["now"].alias("now"), state["rows"].alias("rows"), F.filter(blocks, lambda _, at: reached(blocks, at)).alias("open"), none.alias("turns"))
            return let(
                F.aggregate(steps, start, step),
                lambda x: F.struct(
                    x["now"].alias("now"), x["rows"].alias("rows"), F.concat(x["open"], F.filter(blocks, lambda _, at: ~reached(blocks, at))).alias("open"),
                    F.concat(state["goes"], F.array(x["turns"])).alias("goes"),
                ),
            )

        released = F.transform(state["open"], lambda x: x.withField("release", F.greatest(x["release"], state["now"])))
        return let(F.sort_array(released), run)

    blocks = F.transform("s", lambda x, i: block_of(zero, -x["w"], i, x["blocks"], x["n"]))
    start = F.struct(zero.alias("now"), zero.alias("rows"), blocks.alias("open"), F.filter(F.array(none), lambda _: F.lit(False)).alias("goes"))
    goes = F.sequence(zero, F.call_function("div", F.col("total") - 1, F.lit(_GO).cast("long")))
    made = row.where(F.size("s") > 0).select("keys", F.aggregate(goes, start, go).alias("x")).select("keys", "x.now", "x.rows", F.flatten("x.goes").alias("turns"))
    made = stored(made, "turns")
    slots, rows = made.select("now", "rows").first() or (0, 0)  # what the blocks of sources without a weight come after
    before = Window.partitionBy(F.lit(1)).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)  # a row for each source without a weight
    late = sources.where("w <= 0").select("key", "blocks", "block", *((F.coalesce(F.sum(n).over(before), zero) + told).alias(f"first_{n}") for n, told in (("blocks", slots), ("n", rows))))
    late = late.select("key", "block", "first_blocks", "first_n", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("turn"))
    late = late.select("key", "turn", (F.col("first_blocks") + F.col("turn")).alias("slot"), (F.col("first_n") + F.col("turn") * F.col("block")).alias("start"))
    made = made.select("keys", F.explode("turns").alias("x"))
    return made.select(F.col("keys")[F.col("x.i")].alias("key"), "x.turn", "x.slot", "x.start").unionByName(late)


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int | None = None) -> DataFrame:
    """The rows of docs with ``mix_block`` (number of the block in its source), ``mix_slot`` and
    ``mix_position``: sorted by mix_position, 0 to the number of rows less one, they are the mixture.

    ``weights`` are target weights by source, in any unit; a source that is not named, or has no
    positive weight, comes after all others. By default the weight is the square root of the number
    of rows. A null source is a source of its own. Blocks have ``block`` rows, by default 8 or the rows
    through 65,536, if that is more. Rows of a source are in the order of md5(doc_id), then doc_id; repeated
    rows get a place each. No row is left out or repeated, and there may be any number of sources.
    Columns of docs named mix_block, mix_slot or mix_position are replaced; null and empty texts are
    rows like others; a null doc_id counts as an empty one. An empty table gives an empty result.
    """
    own = [c for c in docs.columns if c not in ("mix_block", "mix_slot", "mix_position")]
    p = "_mix"
    while any(c.lower().startswith(p) for c in own):
        p += "_"
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    # flat columns: those that are not asked for are not shuffled
    plain = docs.select(*own, key.alias(f"{p}key"), digest.alias(f"{p}digest")).withColumn(f"{p}bucket", F.substring(f"{p}digest", 1, 3))
    narrow = plain.select(F.col(f"{p}key").alias("key"), F.col(f"{p}bucket").alias("bucket"))
    sources = stored(_sources(narrow, weights, block), "sources")
    schedule = stored(_schedule(sources), "schedule")
    sizes = narrow.groupBy("key", "bucket").agg(F.count("*").alias("size"))
    so_far = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows a source at most
    starts = sizes.join(sources.select("key", "block"), "key").select(
        F.col("key").alias(f"{p}key"), F.col("bucket").alias(f"{p}bucket"), F.coalesce(F.sum("size").over(so_far), F.lit(0)).alias(f"{p}start"), F.col("block").alias(f"{p}block")
    )
    in_bucket = Window.partitionBy(f"{p}key", f"{p}bucket").orderBy(f"{p}digest", "doc_id")
    ranked = plain.withColumn(f"{p}rank", F.row_number().over(in_bucket) - 1).join(starts, [f"{p}key", f"{p}bucket"])
    ranked = ranked.withColumn(f"{p}index", F.col(f"{p}start") + F.col(f"{p}rank")).withColumn("mix_block", F.expr(f"{p}index div {p}block"))
    blocks = schedule.select(F.col("key").alias(f"{p}key"), F.col("turn").alias("mix_block"), F.col("slot").alias("mix_slot"), F.col("start").alias(f"{p}first"))
    if sources.agg(F.sum("blocks")).first()[0] in range(4 * MOST_BLOCKS):  # some 20 MB; more only where there are very many sources
        blocks = F.broadcast(blocks)
    placed = ranked.join(blocks, [f"{p}key", "mix_block"])
    return placed.select(*own, "mix_block", "mix_slot", (F.col(f"{p}first") + F.col(f"{p}index") - F.col("mix_block") * F.col(f"{p}block")).alias("mix_position"))


#: The mixture of the documents table in DuckDB, with the default arguments.
ORACLE_SQL = """
WITH RECURSIVE keyed AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS k, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents
), size AS (SELECT CAST(greatest(8, ceil(count(*) / 65536)) AS BIGINT) AS block FROM keyed
), counts AS (SELECT k, count(*) AS n, CAST(floor(sqrt(count(*)) * 1000) AS BIGINT) AS w FROM keyed GROUP BY k
), lists AS (
  SELECT list(w ORDER BY k) AS w, list((n + block - 1) // block ORDER BY k) AS b, list(k ORDER BY k) AS k, CAST(sum(w) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS c,
         CAST(sum((n + block - 1) // block) AS BIGINT) AS steps FROM counts, size
), turns(step, now, done, before, pick) AS (
  SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), list_transform(w, lambda x: CAST(0 AS BIGINT)), list_transform(w, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM lists WHERE c > 0
  UNION ALL
  SELECT step + 1, t, list_transform(done, lambda d, i: d + CASE WHEN i = p THEN 1 ELSE 0 END), done, p
  FROM (
    SELECT step, done, t, CAST(list_min(list_transform(list_filter(o, lambda i: (done[i] * total) // w[i] <= t),
      lambda i: {'deadline': ((done[i] + 1) * total + w[i] - 1) // w[i], 'light': -w[i], 'i': i})).i AS BIGINT) AS p
    FROM (
      SELECT step, done, o, total, w, greatest(now + 1, list_min(list_transform(o, lambda i: (done[i] * total) // w[i]))) AS t
      FROM (SELECT step, now, done, total, w, steps, list_filter(range(1, c + 1), lambda i: done[i] < b[i]) AS o FROM turns, lists WHERE step < steps)))
), slots AS (SELECT step, now AS slot, before[pick] AS turn, lists.k[pick] AS k FROM turns, lists WHERE step > 0
), starts AS (
  SELECT slot, turn, k, block, sum(least(block, n - turn * block)) OVER (ORDER BY step) - least(block, n - turn * block) AS start FROM slots JOIN counts USING (k), size
), ranked AS (SELECT doc_id, source, k, row_number() OVER (PARTITION BY k ORDER BY digest, doc_id) - 1 AS index FROM keyed)
SELECT doc_id, source, turn AS mix_block, slot AS mix_slot, CAST(start + index - turn * block AS BIGINT) AS mix_position
FROM ranked JOIN starts ON starts.k = ranked.k AND starts.turn = ranked.index // starts.block
"""
