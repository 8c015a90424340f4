"""Mixing sources to target weights by entropy balancing.

Document rates are those nearest to one copy each, in relative entropy, that meet every
source's target of words: ``rate = min(MOST, exp(lambda * size / mean size))``, with one
multiplier per source. The multipliers solve the convex dual; its Newton steps are
aggregations over the (source, size) counts of all documents. Rates are then rounded into
whole copies so that the words taken stay at the target to within the smallest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import WORD, discard, stored

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix per word of the input.
SHARE = 1.5
#: Most copies of a document, and so of a source's words.
MOST = 2
#: Newton steps stop when every source is this near its target (as a share of it).
NEAR = 1e-9
STEPS = 80
#: Documents of a source that are put in order in one task while rates are rounded.
ORDERED = 5000
#: Rounds in which what rounding left open is sampled for; then documents of a source that
#: are added one by one, largest first. Both end as soon as nothing fits any more.
SAMPLES = 3
FILLS = 8

def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, docs, target) for a table of (source, size).

    Sources in code point order, NULL last, get ``weights`` in turn and share ``share``
    times all words by weight; none gets over ``most`` times its own words, and what it
    leaves is shared among the others. The one ordering over all sources is of one row per
    source: the level at which the shares rise is found from running sums, not by rounds.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    each = each.withColumn("weight", weight.cast("double")).withColumn("most", (most * F.col("source_size")).cast("double"))
    rising = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    everywhere = Window.partitionBy()
    full = F.col("most") / F.col("weight")
    # With the sources before this one full, the level at which the rest meet the budget.
    level = ((share * F.sum("source_size").over(everywhere) - F.sum("most").over(rising) + F.col("most"))
             / (F.sum("weight").over(everywhere) - F.sum("weight").over(rising) + F.col("weight")))
    each = each.withColumn("full", full).withColumn("level", level)
    # Past the first level that its own source can take, levels fall: the first is the largest.
    each = each.withColumn("level", F.max(F.when(F.col("level") <= F.col("full"), F.col("level"))).over(everywhere))
    return each.select("source", "source_size", "docs", F.least("most", F.col("weight") * F.coalesce("level", F.lit(0.0))).alias("target"))


def _rate(most: int) -> Column:
    return F.when(F.col("full"), F.lit(float(most))).otherwise(
        F.least(F.lit(float(most)), F.exp(F.col("multiplier") * F.col("size") / F.col("mean"))))


def solve(counts: DataFrame, aims: DataFrame, most: int = MOST) -> DataFrame:
    """``aims`` with the multiplier of each source, by Newton steps kept inside a bracket.

    ``counts`` is a stored table (source, size, n). The dual's Hessian is diagonal since no
    document belongs to two sources, so a step is one aggregation. A source whose target is
    all it may give is ``full``; one without words has multiplier 0.
    """
    size, mean = F.col("source_size"), F.col("source_size") / F.col("docs")
    now = stored(aims.select(
        "source", "source_size", "docs", "target", F.greatest(mean, F.lit(1.0)).alias("mean"),
        (F.col("target") >= most * size * (1 - 1e-12)).alias("full"), F.lit(0.0).alias("multiplier"),
    ).withColumn("low", F.col("mean") * F.least(F.lit(0.0), F.ln(F.greatest(F.col("target"), F.lit(1e-9)) / F.greatest(size, F.lit(1)))))
     .withColumn("high", F.col("mean") * F.ln(F.lit(float(most)))).withColumn("miss", F.lit(1.0)), "multipliers")
    state = now.columns
    for _ in range(STEPS):
        rated = counts.join(now, counts["source"].eqNullSafe(now["source"])).drop(counts["source"]).withColumn("rate", _rate(most))
        words = F.col("n") * F.col("size") * F.col("rate")
        # Decimal sums do not depend on the order of the parts, so reruns agree to the last digit.
        exact = lambda x: F.sum(x.cast("decimal(30,6)")).cast("double")
        sums = rated.groupBy(*state).agg(
            exact(words).alias("got"),
            exact(F.when(F.col("rate") < most, words * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        over = F.col("got") >= F.col("target")
        step = F.col("multiplier") - (F.col("got") - F.col("target")) / F.nullif("slope", F.lit(0.0))
        moved = sums.withColumn("high", F.when(over, F.col("multiplier")).otherwise(F.col("high"))).withColumn(
            "low", F.when(over, F.col("low")).otherwise(F.col("multiplier"))).withColumn(
            "miss", F.when(F.col("full") | (F.col("source_size") == 0), 0.0).otherwise(
                F.abs(F.col("got") - F.col("target")) / F.greatest(F.col("target"), F.lit(1e-9)))).withColumn(
            "multiplier", F.when(F.col("miss") <= NEAR, F.col("multiplier"))
            .when((step > F.col("low")) & (step < F.col("high")), step).otherwise((F.col("low") + F.col("high")) / 2))
        after = stored(moved.select(*state), "multipliers")
        discard(now)
        now = after
        if (now.agg(F.max("miss")).first()[0] or 0.0) <= NEAR:
            break
    return now


def _fitting(candidates: DataFrame) -> DataFrame:
    """Rows of (row, doc_id, source, docs, size, turn, room) that fit in each source's room in order of ``turn``.

    Sums over buckets of turns tell in which bucket the room is used up; only that one's
    documents are put in order, so a source is never one task's work.
    """
    buckets = 2 * F.ceil(F.col("docs") / ORDERED)
    spread = candidates.filter((F.col("size") > 0) & (F.col("size") <= F.col("room"))).withColumn(
        "bucket", F.least(F.floor(F.col("turn") / (F.col("turn") + 1) * buckets), buckets - 1))
    upto = Window.partitionBy("source").orderBy("bucket")
    sums = spread.groupBy("source", "bucket", "room").agg(F.sum("size").alias("words")).withColumn(
        "before", F.sum("words").over(upto) - F.col("words")).filter("before < room")
    sums = stored(sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before",
                              (F.col("before") + F.col("words") > F.col("room")).alias("edge")), "buckets")
    placed = spread.join(sums, spread["source"].eqNullSafe(sums["s"]) & (spread["bucket"] == sums["b"]))
    inside = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "row")
    at_edge = placed.filter("edge").withColumn("upto", F.col("before") + F.sum("size").over(inside)).filter("upto <= room")
    return placed.filter("NOT edge").select("row").union(at_edge.select("row"))


def copies(words: DataFrame, aims: DataFrame, most: int = MOST) -> DataFrame:
    """``words`` (row, doc_id, source, size; stored) with rate and copies of every document.

    Each document gets the whole part of its rate. The rest of a target is filled with one
    more copy of documents in the order of a hash over the broken part of their rate
    (sequential Poisson sampling) until the next does not fit, then likewise among those
    that do. Everything is a function of the rows; reruns agree.
    """
    counts = stored(words.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    solved = solve(counts, aims, most)
    solved = solved.select(F.col("source").alias("s"), "source_size", "docs", "target", "mean", "full", "multiplier")
    # Saturated rates may come out a hair below the bound; they are as good as whole.
    rate = F.when(_rate(most) > most * (1 - 1e-12), F.lit(float(most))).otherwise(_rate(most))
    draw = (F.pmod(F.xxhash64("doc_id", "source", "size", F.lit(17)), F.lit(1 << 30)) + 1) / float(1 << 30)
    rated = words.join(solved, words["source"].eqNullSafe(solved["s"])).withColumn("rate", rate).withColumn(
        "copies", F.floor("rate").cast("int")).withColumn("turn", F.coalesce(
            draw / F.nullif(F.col("rate") - F.col("copies"), F.lit(0.0)), 1 + draw))
    dealt = stored(rated.select("row", "doc_id", "source", "size", "source_size", "docs", "target", "rate", "turn", "copies"), "rates")
    broken = F.col("rate") > F.col("copies")
    dealt = stored(_more(dealt, _fitting(_with_room(dealt).filter(broken))), "copies")
    added = None
    for sampled in [True] * SAMPLES + [False] * FILLS:
        now = dealt if added is None else _more(dealt, added)
        fits = _with_room(now).filter((F.col("copies") < most) & (F.col("size") > 0) & (F.col("size") <= F.col("room")))
        rows = _fitting(fits) if sampled else fits.groupBy("source").agg(
            F.max_by("row", F.struct("size", "turn", "row")).alias("row")).select("row")
        before = 0 if added is None else added.count()
        added = stored(rows if added is None else rows.union(added), "added")
        if added.count() == before:
            break
    return _more(dealt, added)


def _more(dealt: DataFrame, rows: DataFrame) -> DataFrame:
    """``dealt`` with a copy more for each time its row is in ``rows``."""
    extra = rows.groupBy("row").agg(F.count("*").cast("int").alias("extra"))
    return dealt.join(extra, "row", "left").withColumn(
        "copies", F.col("copies") + F.coalesce("extra", F.lit(0))).drop("extra")


def _with_room(dealt: DataFrame) -> DataFrame:
    """``dealt`` with the words that its source has still to take."""
    room = stored(dealt.groupBy("source").agg(
        (F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("room")).withColumnRenamed("source", "s"), "room")
    return dealt.join(room, dealt["source"].eqNullSafe(room["s"])).drop("s")


def _words(docs: DataFrame, row: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return stored(docs.select(row.alias("row"), F.col("doc_id"), F.col("source"), size.alias("size")), "words")


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, the words the mix takes.

    A NULL text has size 0, a NULL source is a source of its own, last in order. Documents
    without words have ``taken`` 0 at any number of copies. Repeated rows are documents of
    their own. An empty table gives no rows. Columns other than doc_id, source and text are
    not read.
    """
    words = _words(docs, F.monotonically_increasing_id())
    dealt = copies(words, stored(targets(words), "targets"))
    return dealt.select("doc_id", "source", "size", "source_size", "target", "rate", "copies",
                        (F.col("copies") * F.col("size")).alias("taken"))


def sample(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it has copies, numbered in ``copy``.

    All columns are kept; a column named ``copy`` is replaced.
    """
    row = "__kerbline_row"
    numbered = stored(docs.drop("copy").withColumn(row, F.monotonically_increasing_id()), "numbered")
    words = _words(numbered, F.col(row))
    dealt = copies(words, stored(targets(words), "targets")).filter("copies > 0").select(F.col("row").alias(row), F.col("copies").alias("__kerbline_copies"))
    # Always by a shuffle: the copies table has a row per document and outgrows any broadcast.
    return numbered.join(stored(dealt, "dealt").hint("merge"), row).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("__kerbline_copies")))).drop(row, "__kerbline_copies")
