"""As-of predecessor: every row of a counter series with the rows of its entity's latest earlier time.

Plan. A window per entity would put a busy entity (one interface name, the untagged master)
into a single task. The series is therefore cut into time chunks and shuffled once by
``(entity, chunk)``. There, a window over the chunk gives every row the latest earlier time; rows of
the first time of a chunk take the last time of the entity's previous chunk, which comes from one
small row per ``(entity, chunk)``. Both branches read the same exchange: they read the same columns.

A time with one row has its figures beside it, so series without copies are done then. Only rows
behind a time of several rows meet those in a join by entity and time, in blocks of bounded size, so
that memory stays bounded however many rows share a time.

A chunk of an entity that holds very many rows would still be one task. With ``most_rows`` the rows
of every ``(entity, chunk)`` are counted per slice of time first (combined in the tasks); the
chunks above that bound are cut where the running count passes a multiple of it, into ranges of
about as many rows, and each range gets the last rows of the range before it, as chunks do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshlens.functions.measures import in_window

CHUNK_MS = 24 * 3_600_000
#: Rows of one time that are packed together at most, where times of several rows meet.
BLOCK = 256
#: Slices of a chunk in which its rows are counted.
SLICES = 1440


def with_predecessor(
    rows: DataFrame,
    entity: list[str],
    figures: list[str],
    t_ms: str = "t_ms",
    *,
    chunk_ms: int = CHUNK_MS,
    most_rows: int | None = None,
    paired: bool = True,
) -> DataFrame:
    """Add ``prev_ms`` and ``prev_<figure>`` for bigint ``figures``; drop rows without one.

    Rows with a NULL in ``entity`` or ``t_ms`` take no part. A predecessor is strictly earlier,
    also among rows that share a time. When several rows of an entity share the predecessor
    time, the row is paired with each of them; with ``paired=False`` every row comes once, with the
    time before alone. ``most_rows`` bounds the rows of a task, but for those of one slice of time (a
    1,440th of a chunk).
    """
    keys = [*entity, t_ms]
    known = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    others = [c for c in rows.columns if c not in keys and c not in figures]
    placed = known.select(*keys, F.expr(f"`{t_ms}` div {chunk_ms}").alias("_chunk"), *others, *figures)
    place = [*entity, "_chunk"]
    if most_rows is not None:
        placed = in_ranges(placed, place, F.expr(f"pmod(`{t_ms}`, {chunk_ms}) * {SLICES} div {chunk_ms}"), most_rows)
        place = [*place, "_range"]
    placed = placed.repartition(*place).withColumn("_one", _one(placed, [*others, *figures]))
    if paired:
        placed = placed.withColumn("_n", F.sum("_one").over(W.partitionBy(*place, t_ms)))
    # A time's figures count only where it has one row.
    now_at = F.struct(
        F.col(t_ms).alias("ms"),
        F.col("_n" if paired else "_one").alias("n"),
        *(F.col(c).alias(f"f{k}") for k, c in enumerate(figures if paired else [])),
    )
    earlier = W.partitionBy(*place).orderBy(t_ms).rangeBetween(W.unboundedPreceding, -1)
    linked = placed.withColumn("_inside", F.last(now_at).over(earlier))
    tails = placed.groupBy(*place).agg(F.max_by(now_at, t_ms).alias("_tail"))
    heads = tails.select(
        *place,
        F.lag("_tail").over(W.partitionBy(*entity).orderBy(*place[len(entity) :])).alias("_before"),
    )
    found = (
        linked.join(heads, place, "left")
        .withColumn("_prev", F.coalesce("_inside", "_before"))
        .where("_prev IS NOT NULL")
    )
    row = [*keys, *others, *figures, F.col("_prev.ms").alias("prev_ms")]
    if not paired:
        return found.select(*row)
    alone = found.where("_prev.n = 1").select(*row, *(F.col(f"_prev.f{k}").alias(f"prev_{c}") for k, c in enumerate(figures)))
    now = placed.where("_n > 1").select(
        *entity, F.col(t_ms).alias("prev_ms"), *(F.col(c).alias(f"prev_{c}") for c in figures)
    )
    return alone.unionByName(pairs(found.where("_prev.n > 1").select(*row), now, [*entity, "prev_ms"]))


def _one(rows: DataFrame, columns: list[str]) -> Column:
    """1, from all columns: so that every branch behind an exchange reads the same ones, and the exchange is shared."""
    plain = [c for c in columns if not any(k in rows.schema[c].dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(*plain).bitwiseAND(F.lit(0)) + 1 if plain else F.lit(1).cast("bigint")


def pairs(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with each of the ``others`` of equal ``keys``, which has no NULL.

    The others travel to their key as rows and are packed there in blocks of ``BLOCK`` at most, which the
    join meets as a whole: a block costs one step of the join, and no key is ever held as a whole.
    """
    values = [c for c in others.columns if c not in keys]
    # So many tasks whatever the bytes: the work is in the pairs.
    tasks = int(others.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = others.repartition(tasks, *keys).sortWithinPartitions(*keys)
    blocks = (
        sorted_.withColumn("_block", F.expr(f"monotonically_increasing_id() div {BLOCK}"))
        .groupBy(*keys, "_block")
        .agg(F.collect_list(F.struct(*values)).alias("_others"))
    )
    both = rows.join(blocks, keys).select(*(rows[c] for c in rows.columns), F.explode("_others").alias("_other"))
    return both.select(*rows.columns, *(F.col(f"_other.{c}") for c in values))


def in_ranges(rows: DataFrame, place: list[str], slice_: Column, most_rows: int) -> DataFrame:
    """Add ``_range``: ascending with time, 0 throughout where ``place`` has ``most_rows`` rows at most.

    Only places above the bound get cuts, at most one for every ``most_rows`` rows of the input.
    """
    counts = rows.groupBy(*place, slice_.alias("_slice")).agg(F.count("*").alias("_n"))
    # A slice starts a range when its first row is the first one behind a multiple of the bound.
    before = F.sum("_n").over(W.partitionBy(*place).orderBy("_slice")) - F.col("_n")
    started = F.expr(f"_before div {most_rows}")
    cuts = (
        counts.withColumn("_before", before)
        .groupBy(*place, started.alias("_nth"))
        .agg(F.min("_slice").alias("_cut"))
        .where("_nth > 0")
        .groupBy(*place)
        .agg(F.collect_list("_cut").alias("_cuts"))
    )
    # The range of every slice, once for each place, so that a row looks it up in one step.
    ranges = cuts.select(
        *place,
        F.transform(
            F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda s: F.size(F.filter("_cuts", lambda cut: cut <= s))
        ).alias("_ranges"),
    )
    cut = rows.withColumn("_at", slice_.cast("int")).join(ranges, place, "left")
    return cut.withColumn("_range", F.coalesce(F.get("_ranges", F.col("_at")), F.lit(0))).drop("_ranges", "_at")


def clip_history(
    rows: DataFrame,
    entity: list[str],
    figures: list[str],
    from_ms: int | None,
    to_ms: int | None,
    t_ms: str = "t_ms",
    *,
    at: str | None = None,
) -> DataFrame:
    """Rows of a closed time window plus, per entity, all rows of its last time before it.

    Exact: of the history before ``from_ms`` only the rows at the last time of each entity are
    shuffled and sorted; those times come from a map-side aggregate. ``at`` names the stored
    timestamp behind ``t_ms``; bounds on it prune the scan.
    """

    def within(low: int | None, high: int | None) -> Column:
        if at is not None:
            return in_window(F.col(at), low, high)
        test = F.lit(True)
        if low is not None:
            test = test & (F.col(t_ms) >= low)
        return test if high is None else test & (F.col(t_ms) <= high)

    if from_ms is None:
        return rows if to_ms is None else rows.where(within(None, to_ms))
    before = rows.where(within(None, from_ms - 1)).select(*entity, *figures, t_ms)
    last = before.groupBy(*entity).agg(F.max(t_ms).alias(t_ms))
    carried = before.join(last, [*entity, t_ms])
    return rows.where(within(from_ms, to_ms)).unionByName(carried, allowMissingColumns=True)
