"""Order-dependent primitives that never put a whole key into one task.

A video, task or stream may hold a large share of all rows, so a plain
``Window.partitionBy(video)`` would sort that share in a single task.  Every primitive here
cuts the order axis of a key into blocks of a fixed width, works inside ``(key, block)``,
and only lets small summaries of blocks meet, which are cut into groups in the same way.

The order axis is a BIGINT: a frame number, a chunk index, or microseconds.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions (frames, chunk indexes) per block.
BLOCK = 65_536
#: Block width for axes in microseconds: ten seconds.  A stream that receives a large share of
#: all rows within an hour is cut into hundreds of parts, and the three million blocks of a year
#: into less than a thousand groups.
TIME_BLOCK_US = 10_000_000
#: One hour, for axes with few rows.
HOUR_US = 3_600_000_000

_BLK = "__block"


def block_start(position: Column, width: int) -> Column:
    """First position of the block that holds ``position``; exact in BIGINT."""
    return position - F.pmod(position, F.lit(width).cast("bigint"))


def micros(ts: Column) -> Column:
    """A timestamp as a position on the microsecond axis."""
    return F.unix_micros(ts.cast("timestamp"))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    position: Column,
    tie: Sequence[str] = (),
    *,
    width: int = BLOCK,
    rank: str | None = None,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Prefix computations per key in the order ``(position, *tie)``.

    ``rank`` adds the zero-based row number, ``sums`` and ``maxes`` running values that
    include the current row, ``previous`` the values of the row before (NULL at the first).
    ``(position, *tie)`` must be unique within a key.  A NULL key is a key like any other, and
    a NULL position comes before all others.
    """
    keys = list(keys)
    sums, maxes, previous = dict(sums or {}), dict(maxes or {}), dict(previous or {})
    order = F.struct(position.alias("p"), *[F.col(t) for t in tie]) if tie else position
    adds = {**({rank: F.lit(1)} if rank else {}), **sums}
    values = {f"__sum_{n}": c for n, c in adds.items()} | {f"__max_{n}": c for n, c in maxes.items()}
    if previous:
        values["__row"] = F.struct(*[c.alias(n) for n, c in previous.items()])
    rows = df.withColumns({_BLK: block_start(position, width), "__order": order, **values})
    # Column by column: fixed-width values under a plain position stay hash-aggregated.
    # Rows without a position fill a block of their own, where any order that is not NULL will do.
    latest = F.col("__order") if tie else F.coalesce(F.col("__order").cast("bigint"), F.lit(0).cast("bigint"))
    totals = _fold(adds, maxes)
    if previous:
        totals += [F.max_by(c, latest).alias(f"__prev_{n}") for n, c in previous.items()]
    summary = rows.groupBy(*keys, _BLK).agg(*totals)
    if previous:
        last = F.struct(*[F.col(f"__prev_{n}").alias(n) for n in previous])
        summary = summary.withColumn("__row", last).drop(*[f"__prev_{n}" for n in previous])
    # What came before a block stands in front of it as a row of its own, so running values
    # need neither a join nor a correction, and NULL keys are keys like any other.
    marked = rows.withColumn("__real", F.lit(True)).unionByName(
        _before(summary, keys, adds, maxes, bool(previous), width).withColumn("__real", F.lit(False)), allowMissingColumns=True
    )
    here = Window.partitionBy(*keys, _BLK).orderBy("__real", "__order")
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {f"__out_{n}": F.sum(f"__sum_{n}").over(upto) for n in adds} | {
        f"__out_{n}": F.max(f"__max_{n}").over(upto) for n in maxes
    }
    if previous:
        out["__out"] = F.lag("__row").over(here)
    result = [(F.col(f"__out_{n}") - 1).alias(n) if n == rank else F.col(f"__out_{n}").alias(n) for n in (*adds, *maxes)]
    result += [F.col("__out")[n].alias(n) for n in previous]
    return marked.withColumns(out).where("__real").select(*df.columns, *result)


#: Block summaries that meet in one window.
SUMMARIES = 4_096


def _fold(sums: Mapping[str, Column], maxes: Mapping[str, Column]) -> list[Column]:
    return [F.sum(f"__sum_{n}").alias(f"__sum_{n}") for n in sums] + [F.max(f"__max_{n}").alias(f"__max_{n}") for n in maxes]


def _before(summary: DataFrame, keys: list[str], sums: Mapping, maxes: Mapping, rows: bool, width: int) -> DataFrame:
    """Per block what all earlier blocks of its key amount to; first blocks have no row.

    The summaries of a key are cut into groups of ``SUMMARIES`` blocks in turn, and only the
    totals of those groups meet in a window of the key.
    """
    last = [F.max_by("__row", F.coalesce(_BLK, F.lit(-(1 << 62)))).alias("__row")] if rows else []
    group = "__group"
    grouped = summary.withColumn(group, block_start(F.col(_BLK), width * SUMMARIES))

    def exclusive(df: DataFrame, part: list[str], by: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*by)
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        new = {f"__sum_{n}": F.sum(f"__sum_{n}").over(earlier) for n in sums} | {
            f"__max_{n}": F.max(f"__max_{n}").over(earlier) for n in maxes
        }
        if rows:
            new["__row"] = F.lag("__row").over(w)
        return df.withColumns({"__place": F.row_number().over(w), **new}).where("__place > 1").drop("__place")

    totals = grouped.groupBy(*keys, group).agg(*_fold(sums, maxes), *last)
    ahead = exclusive(totals, keys, [group]).withColumn("__real", F.lit(False))
    both = grouped.withColumn("__real", F.lit(True)).unionByName(ahead, allowMissingColumns=True)
    return exclusive(both, [*keys, group], ["__real", _BLK]).where("__real").drop("__real", group)


def islands(
    df: DataFrame,
    keys: Sequence[str],
    start: Column,
    end: Column,
    *,
    gap: int = 0,
    width: int = BLOCK,
    maxes: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Merge disjoint intervals whose distance ``start - previous_end - 1`` is at most ``gap``.

    Returns ``keys, start, end`` and the requested aggregates per merged interval.  Blocks
    merge their own intervals first; only the first and last island of every block can
    continue elsewhere, so no more than two rows per block meet in the per-key step.
    """
    keys = list(keys)
    maxes, sums = dict(maxes or {}), dict(sums or {})
    rows = df.select(
        *keys,
        start.cast("bigint").alias("start"),
        end.cast("bigint").alias("end"),
        *[c.alias(n) for n, c in maxes.items()],
        *[c.alias(n) for n, c in sums.items()],
    ).withColumn(_BLK, block_start(F.col("start"), width))

    merge = [F.min("start").alias("start"), F.max("end").alias("end")]
    merge += [F.max(n).alias(n) for n in maxes]
    merge += [F.sum(n).alias(n) for n in sums]

    def number(part: str) -> Column:
        w = Window.partitionBy(*keys, part).orderBy("start")
        prev = F.lag("end").over(w)
        return F.when(prev.isNull() | (F.col("start") - prev - 1 > gap), 1).otherwise(0)

    def group_id(part: str) -> Column:
        w = Window.partitionBy(*keys, part).orderBy("start")
        return F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    local = (
        rows.withColumn("__new", number(_BLK))
        .withColumn("__g", group_id(_BLK))
        .withColumn("__ng", F.sum("__new").over(Window.partitionBy(*keys, _BLK)))
        .groupBy(*keys, _BLK, "__g")
        .agg(*merge, F.max("__ng").alias("__ng"))
    )
    at_edge = (F.col("__g") == 1) | (F.col("__g") == F.col("__ng"))
    return (
        local.withColumn("__part", F.when(at_edge, F.lit(-1).cast("bigint")).otherwise(F.col(_BLK)))
        .withColumn("__new", number("__part"))
        .withColumn("__g2", group_id("__part"))
        .groupBy(*keys, "__part", "__g2")
        .agg(*merge)
        .drop("__part", "__g2")
    )


def _identity(position: Column) -> Column:
    return position.cast("bigint")


def locate(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    position: str,
    start: str,
    end: str,
    payload: Sequence[str] = (),
    *,
    how: str = "inner",
    width: int = BLOCK,
    axis: Callable[[Column], Column] = _identity,
    after_start: bool = False,
) -> DataFrame:
    """Attach to every point the interval ``[start, end]`` of its key that holds it.

    The intervals of one key must not overlap, except that one may end where the next
    starts when ``after_start`` is set (then a point belongs to ``(start, end]``).  Each
    interval is repeated once per block it touches, and inside a block points and interval
    starts are merged in order, so the cost is a sort and no candidate pairs are formed.
    ``axis`` maps positions to the BIGINT axis of the blocks, e.g. seconds to microseconds.
    ``how`` is ``inner``, ``left`` or ``anti``.
    """
    keys = list(keys)
    step = F.lit(width).cast("bigint")

    def blk(c: str) -> Column:
        return block_start(axis(F.col(c)), width)

    held = F.struct(
        F.col(start).alias("__s"), F.col(end).alias("__e"), *[F.col(c) for c in payload]
    )
    first_kind, last_kind = (1, 0) if after_start else (0, 1)
    iv = intervals.select(
        *keys, held.alias("__iv"), blk(start).alias("__own"),
        F.explode(F.sequence(blk(start), blk(end), step)).alias(_BLK),
    ).select(
        *keys,
        _BLK,
        # Copies in later blocks sort before everything there (NULL first).
        F.when(F.col(_BLK) == F.col("__own"), F.col("__iv.__s")).alias("__pos"),
        F.lit(first_kind).alias("__kind"),
        # Plain columns rather than one struct: unused ones are pruned down to the scan.
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in points.schema if f.name not in keys],
        "__iv",
    )
    pts = points.select(
        *keys,
        blk(position).alias(_BLK),
        F.col(position).alias("__pos"),
        F.lit(last_kind).alias("__kind"),
        *[c for c in points.columns if c not in keys],
        F.lit(None).cast(iv.schema["__iv"].dataType).alias("__iv"),
    )
    w = (
        Window.partitionBy(*keys, _BLK)
        .orderBy("__pos", "__kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    merged = (
        pts.unionByName(iv)
        .withColumn("__hit", F.last("__iv", ignorenulls=True).over(w))
        .where(F.col("__kind") == last_kind)
        .withColumn("__hit", F.when(F.col("__hit.__e") >= F.col("__pos"), F.col("__hit")))
    )
    if how == "anti":
        return merged.where("__hit is null").select(*points.columns)
    if how == "inner":
        merged = merged.where("__hit is not null")
    extra = {start: "__s", end: "__e"}
    names = [c for c in (start, end, *payload) if c not in points.columns]
    return merged.select(
        *points.columns, *[F.col(f"__hit.{extra.get(c, c)}").alias(c) for c in names]
    )


def with_halo(df: DataFrame, position: Column, reach: int, width: int, *, trailing: bool = False) -> DataFrame:
    """Copy rows within ``reach`` of a block edge to the neighbouring block.

    Adds ``block`` and ``is_home``.  A window over ``(key, block)`` then sees every
    neighbour of its home rows that lies within ``reach`` (``reach`` must not exceed
    ``width``); keep only ``is_home`` rows afterwards.  With ``trailing`` a window looks
    back only, and rows are copied to the following block alone.
    """
    step = F.lit(width).cast("bigint")
    home = block_start(position, width)
    offset = position - home
    blocks = F.array_compact(
        F.array(
            home,
            F.lit(None).cast("bigint") if trailing else F.when(offset < reach, home - step),
            F.when(offset >= width - reach, home + step),
        )
    )
    return (
        df.withColumn("__home", home)
        .withColumn("block", F.explode(blocks))
        .withColumn("is_home", F.col("block") == F.col("__home"))
        .drop("__home")
    )


def previous_dense(df: DataFrame, keys: Sequence[str], index: str, cols: Mapping[str, str]) -> DataFrame:
    """Values of the row whose dense ``index`` is one lower (``new name -> column``).

    Every row is sent to its own slot and to the next one, so the exchange is on
    ``(keys, index)`` and the input is read once.  ``(keys, index)`` must be unique.
    """
    rest = [c for c in df.columns if c not in (*keys, index)]
    mine = F.struct(*rest)
    theirs = F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
    nothing = lambda s: F.lit(None).cast(df.select(s).schema[0].dataType)
    slots = F.array(
        F.struct(F.col(index).alias("i"), mine.alias("mine"), nothing(theirs).alias("theirs")),
        F.struct((F.col(index) + 1).alias("i"), nothing(mine).alias("mine"), theirs.alias("theirs")),
    )
    return (
        df.select(*keys, F.explode(slots).alias("s"))
        .groupBy(*keys, F.col("s.i").alias(index))
        .agg(F.first("s.mine", ignorenulls=True).alias("m"), F.first("s.theirs", ignorenulls=True).alias("t"))
        .where("m is not null")
        .select(*keys, index, "m.*", *[F.col(f"t.{n}").alias(n) for n in cols])
    )
