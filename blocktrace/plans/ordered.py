"""Ordered computations per key that stay balanced when a key is hot.

``ordered_columns`` answers, for each row, questions about the rows before and
after it in its key: running sums, the last few values, the first value, the
next value. Where no key is heavy, keys are shuffled and windowed whole.
Otherwise rows are cut into ordered chunks; each part of a key in a chunk is
windowed by itself and written. Only keys that go over the edge of a chunk are
completed, from a summary with at most two rows per chunk that is broadcast, so
no task ever holds a whole hot key and no summary of all keys is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blocktrace.plans.layout import CHUNK, chunk_count, heavy_key, with_chunk
from blocktrace.plans.storage import attach, counted, scanned, settle, settle_counted


def _last(values: Column, depth: int) -> Column:
    """Newest `depth` elements; short arrays are kept whole."""
    size = F.least(F.lit(depth), F.size(values))
    return F.when(F.size(values) == 0, values).otherwise(F.slice(values, -size, size))


def ordered_columns(df: DataFrame, keys: list[str], order: list[str], *,
                    running: Mapping[str, Column] | None = None,
                    past: Mapping[str, tuple[str, int]] | None = None,
                    first: Mapping[str, str] | None = None,
                    following: Mapping[str, str] | None = None) -> DataFrame:
    """Add columns that depend on a row's place in its key.

    running
        ``{alias: weight}`` sum of the weights of all earlier rows (0 at the start).
    past
        ``{alias: (column, depth)}`` up to `depth` earlier values, oldest first.
    first
        ``{alias: column}`` value at the first row of the key.
    following
        ``{alias: column}`` value at the next row, null on the last.

    `order` must be a total order within a key, of orderable columns; keys are
    not null. The input is computed once, and written only if it is not stored
    rows already.
    """
    running, past = dict(running or {}), dict(past or {})
    first, following = dict(first or {}), dict(following or {})
    stored, rows = counted(df)
    chunks = chunk_count(stored.sparkSession, rows)
    # A single chunk, and chunks of whole keys, have no edges: nothing is cut, written or completed.
    cut = chunks > 1 and heavy_key(stored, keys)
    if cut:
        df = with_chunk(stored, keys, order, chunks)
    else:
        df = stored if chunks == 1 else stored.repartition(chunks, *keys)
    parts = [*keys, CHUNK] if cut else keys
    weights = {alias: f"_w_{alias}" for alias in running}
    for alias, weight in running.items():
        df = df.withColumn(weights[alias], weight)

    ahead = Window.partitionBy(*parts).orderBy(*order)
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    columns: dict[str, Column] = {}
    for alias in running:
        columns[alias] = F.coalesce(F.sum(weights[alias]).over(before), F.lit(0))
    for alias, (column, depth) in past.items():
        if depth == 1:
            previous = F.lag(column).over(ahead)
            columns[alias] = F.when(previous.isNull(), F.array().cast(f"array<{_type(df, column)}>")) \
                .otherwise(F.array(previous))
        else:
            columns[alias] = F.collect_list(column).over(ahead.rowsBetween(-depth, -1))
    for alias, column in first.items():
        columns[alias] = F.first(column).over(ahead.rowsBetween(Window.unboundedPreceding, 0))
    for alias, column in following.items():
        columns[alias] = F.lead(F.struct(F.col(column).alias("v"))).over(ahead)
    if not cut:
        columns |= {alias: columns[alias]["v"] for alias in following}
        return df.withColumns(columns).drop(*weights.values())
    out = settle(df.withColumns(columns), "ordered")
    # At most two rows a chunk, whatever the number of keys.
    carry = F.broadcast(_carry(out, keys, order, weights, past, first, following))
    matched = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    matched.append(F.col(f"l.{CHUNK}") == F.col(f"r.{CHUNK}"))
    condition = matched[0]
    for part in matched[1:]:
        condition = condition & part
    joined = out.alias("l").join(carry.alias("r"), condition, "left")
    result = []
    for name in out.columns:
        if name == CHUNK or name in weights.values():
            continue
        column = F.col(f"l.{name}")
        if name in running:
            column = column + F.coalesce(F.col(f"r._c_{name}"), F.lit(0))
        elif name in past:
            kept = F.coalesce(F.col(f"r._c_{name}"), F.array().cast(f"array<{_type(df, past[name][0])}>"))
            column = _last(F.concat(kept, column), past[name][1])
        elif name in first:
            head = F.col(f"r._c_{name}")
            column = F.when(head.isNotNull(), head["v"]).otherwise(column)
        elif name in following:
            column = F.coalesce(column, F.col(f"r._c_{name}"))["v"]
        result.append(column.alias(name))
    return joined.select(*result)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _carry(rows: DataFrame, keys: list[str], order: list[str], weights: Mapping[str, str],
           past: Mapping[str, tuple[str, int]], first: Mapping[str, str],
           following: Mapping[str, str]) -> DataFrame:
    """What the parts of a key that goes over a chunk's edge need from the parts before and after.

    Chunks are ranges of (keys, order): a key that goes on in another chunk is
    the first or the last one of its chunk. The last row of a chunk knows the
    sums and the newest values of its key, the first row the value at its head.
    """
    place = F.struct(*[F.col(c) for c in dict.fromkeys([*keys, *order])])
    own = [F.col(k) for k in keys]
    # In a struct, a null value differs from no row at all.
    heads = {**first, **following}
    low = F.struct(*own, *[F.struct(F.col(c).alias("v")).alias(f"_h_{alias}") for alias, c in heads.items()])
    newest = {alias: _last(F.when(F.col(c).isNull(), F.col(alias)).otherwise(F.concat(alias, F.array(c))), depth)
              for alias, (c, depth) in past.items()}
    high = F.struct(
        *own, *[(F.col(alias) + F.coalesce(w, F.lit(0))).alias(f"_s_{alias}") for alias, w in weights.items()],
        *[values.alias(f"_t_{alias}") for alias, values in newest.items()],
        *[F.struct(F.col(alias).alias("v")).alias(f"_h_{alias}") for alias in first])
    edges = rows.groupBy(CHUNK).agg(F.min_by(low, place).alias("_low"), F.max_by(high, place).alias("_high"))
    one_key = F.lit(True)
    for k in keys:
        one_key = one_key & (F.col(f"_low.{k}") == F.col(f"_high.{k}"))
    edges = edges.withColumn("_one", one_key)

    def part(side: str, inside: Column, head: Mapping[str, str]) -> DataFrame:
        columns = [F.when(inside, F.col(f"_high.{name}")).alias(name)
                   for name in [*(f"_s_{a}" for a in weights), *(f"_t_{a}" for a in past)]]
        columns += [F.col(f"{side}.{n}").alias(n) if a in head else F.lit(None).alias(n)
                    for a, n in ((a, f"_h_{a}") for a in heads)]
        return edges.select(*[F.col(f"{side}.{k}").alias(k) for k in keys], CHUNK, "_one", *columns)

    # A key that is first and last in its chunk is one part with all of it.
    summary = part("_low", F.col("_one"), heads).unionByName(
        part("_high", F.lit(True), first).filter(~F.col("_one")))
    along = Window.partitionBy(*keys).orderBy(CHUNK)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    columns = [F.sum(f"_s_{alias}").over(earlier).alias(f"_c_{alias}") for alias in weights]
    for alias, (_, depth) in past.items():
        columns.append(_last(F.flatten(
            F.collect_list(f"_t_{alias}").over(along.rowsBetween(-depth, -1))), depth)
            .alias(f"_c_{alias}"))
    columns += [F.first(f"_h_{alias}").over(earlier).alias(f"_c_{alias}") for alias in first]
    columns += [F.lead(f"_h_{alias}").over(along).alias(f"_c_{alias}") for alias in following]
    return summary.select(*keys, CHUNK, *columns)


def with_ordinal(df: DataFrame, keys: list[str], order: list[str], alias: str) -> DataFrame:
    """0-based place of each row in its key."""
    return ordered_columns(df, keys, order, running={alias: F.lit(1).cast("long")})


#: Slots per key that a prefix is searched in; a power of two.
SLOTS = 256


def _slots(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows with the number of their `_slot`: how many bounds between the slots of their key are below the value.

    The bounds are in order, so a row finds its slot by halving. Each step is a column of its own: in one
    expression, every step would be computed again by the steps after it.
    """
    shares = [i / SLOTS for i in range(1, SLOTS)]
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(column, shares).alias("_cuts"))
    placed, step = attach(rows, cuts, keys).withColumn("_slot", F.lit(0)), SLOTS // 2
    while step:
        below = F.try_element_at("_cuts", F.col("_slot") + step) < F.col(column)
        placed = placed.withColumn("_slot", F.col("_slot") + F.when(below, step).otherwise(0))
        step //= 2
    return placed.drop("_cuts")


def ordered_prefix(df: DataFrame, keys: list[str], order: list[str], *,
                   n: int | None = None, fraction: float | None = None, coarse: int = 0) -> DataFrame:
    """The first `n` rows, or the earliest share, of each key in `order`.

    This selects instead of ranking. Rows are counted in slots, which are
    ranges of the first order column between approximate percentiles, or the
    values of the first `coarse` order columns where those are few. The counts
    name the slot with the last wanted row; only that slot is put in order, to
    find the row. All rows are then filtered in place without a shuffle. The
    first order column is a number or a time unless `coarse` is given.
    """
    if (n is None) == (fraction is None):
        raise ValueError("give exactly one of n and fraction")
    rows = df if scanned(df) else settle(df, "rows")
    narrow = rows.select(*dict.fromkeys([*keys, *order]))
    narrow = narrow.withColumn("_slot", F.struct(*order[:coarse])) if coarse else _slots(narrow, keys, order[0])
    counts = settle(narrow.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_held")), "slots")
    whole, along = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_slot")
    total = F.sum("_held").over(whole)
    wanted = F.lit(n).cast("long") if n is not None else F.bround(F.lit(fraction) * total).cast("long")
    placed = counts.select(
        *keys, "_slot", "_held", F.least(wanted, total).alias("_want"),
        F.coalesce(F.sum("_held").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    target = placed.filter((F.col("_ahead") < F.col("_want")) & (F.col("_want") <= F.col("_ahead") + F.col("_held"))) \
        .select(*keys, F.col("_slot").alias("_target"), (F.col("_want") - F.col("_ahead") - 1).alias("_place"))
    inside = attach(narrow, target, keys).filter(F.col("_slot") == F.col("_target")).drop("_slot", "_target")
    cut = (with_ordinal(inside, keys, order, "_rank").filter(F.col("_rank") == F.col("_place"))
           .select(*keys, F.struct(*order).alias("_last")))
    return (attach(rows, cut, keys).filter(F.struct(*order) <= F.col("_last"))
            .drop("_last").select(*df.columns))


def _ranked_slots(counts: DataFrame, totals: DataFrame, keys: list[str], value: str,
                  shares: list[float]) -> DataFrame:
    """Rows of a histogram (`_n`) in the slots that hold a wanted rank, with the number of values before each."""
    narrow = _slots(counts, keys, value)
    held = settle(narrow.groupBy(*keys, "_slot").agg(F.sum("_n").alias("_held")), "slots")
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = held.withColumn("_ahead", F.coalesce(F.sum("_held").over(earlier), F.lit(0)))
    wanted = F.lit(False)
    for share in shares:
        spot = (F.col("_total") - 1) * F.lit(float(share))
        # Slots from the one with the lower neighbour to the one with the upper.
        wanted = wanted | ((F.col("_ahead") <= F.ceil(spot)) & (F.floor(spot) < F.col("_ahead") + F.col("_held")))
    target = attach(placed, totals, keys).filter(wanted).select(*keys, "_slot", "_ahead")
    inside = attach(narrow, target, [*keys, "_slot"])
    ranked = ordered_columns(inside, [*keys, "_slot"], [value], running={"_inside": F.col("_n")})
    return ranked.withColumn("_start", F.col("_ahead") + F.col("_inside")).drop("_slot", "_ahead", "_inside")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per key.

    Values are first reduced to a histogram. One that a task may order is
    ranked whole. A larger one is counted in slots, and only the slots that hold
    one of the wanted ranks are put in order. Only the two neighbours of each
    wanted rank are kept.
    """
    counts, distinct = settle_counted(df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
                                      .agg(F.count(F.lit(1)).alias("_n")), "histogram")
    totals = settle(counts.groupBy(*keys).agg(F.sum("_n").alias("_total")), "totals")
    if chunk_count(counts.sparkSession, distinct) == 1:
        ranked = ordered_columns(counts, keys, [value], running={"_start": F.col("_n")})
    else:
        ranked = _ranked_slots(counts, totals, keys, value, list(shares.values()))
    placed = attach(ranked, totals, keys)
    picks = []
    for alias, share in shares.items():
        spot = (F.col("_total") - 1) * F.lit(float(share))
        for side, rank in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            inside = (rank >= F.col("_start")) & (rank < F.col("_start") + F.col("_n"))
            picks.append(F.max(F.when(inside, F.col(value).cast("double"))).alias(f"_{side}_{alias}"))
    found = placed.groupBy(*keys, "_total").agg(*picks)
    result = []
    for alias, share in shares.items():
        spot = (F.col("_total") - 1) * F.lit(float(share))
        low, high = F.col(f"_lo_{alias}"), F.col(f"_hi_{alias}")
        between = (F.ceil(spot) - spot) * low + (spot - F.floor(spot)) * high
        result.append(F.when(low == high, low).otherwise(between).alias(alias))
    return found.select(*keys, *result)
