"""Order statistics by selection: ranks are narrowed down by partial
aggregates, so rows are neither sorted nor exchanged nor written.

``selected_quantiles`` keeps, per key and wanted rank, a bracket of values
that holds it. A pass counts the rows below each bracket's ends and takes an
approximate quantile sketch of the rows between them, from which the next
bracket follows: the first has about 4 / 10,000 of the rows, every further
one about 3 / 100 of the one before. An end that is the wanted value ends the
search, however many rows share it; a bracket of few rows is finished by
counting its distinct values. A sketch that missed is noticed by the counts
and the bracket moved.

``smallest`` finds, per group, the border of the ``take`` smallest rows by
(hash, key): a pass counts rows by the next three hex digits of the hash and
follows the digits that hold the border. The rows are then chosen by
comparing them with it.

What is aggregated has one row per key (4,096 per group for ``smallest``);
partial states are combined before they move, however hot the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlane.session import materialize

ACCURACY = 10_000
STEPS = 100                    # values of a bracket's sketch
FEW = 10_000                   # rows in a bracket whose values are counted one by one
DIGITS = 3
HASH_DIGITS = 30               # of the 32 of an md5
MAX_PASSES = 20


def _with_state(d: DataFrame, state: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows with their key's row of ``state`` (null keys are a key; without
    keys the one row's values are literals)."""
    if not keys:
        row = state.first()
        d = d if row or how == "left" else d.where("false")
        return d.withColumns({f.name: F.lit(row[f.name] if row else None).cast(f.dataType) for f in state.schema.fields})
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_s_{k}"))
        on = same if on is None else on & same
    s = state
    for k in keys:
        s = s.withColumnRenamed(k, f"_s_{k}")
    return d.join(s, on, how).drop(*[f"_s_{k}" for k in keys])


def selected_quantiles(d: DataFrame, keys: Sequence[str], probs: Sequence[float], names: Sequence[str], accuracy: int = ACCURACY, few: int = FEW) -> DataFrame:
    """Quantiles with linear interpolation of the non-null column ``_v`` per
    key (the whole frame without keys)."""
    keys = list(keys)
    m = len(probs)
    at = range(2 * m)                                         # the ranks below and above each quantile
    slack = 2.0 / accuracy
    pieces = max(min(STEPS, accuracy // 10), 10)              # of a bracket's sketch
    steps = [s / pieces for s in range(pieces + 1)]
    few = max(few, 10 * pieces)
    around = sorted({min(max(p + s, 0.0), 1.0) for p in probs for s in (-slack, slack)})
    first = d.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"),
                                 F.percentile_approx("_v", around, accuracy).alias("_q"))
    h = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    ranks = [F.floor(x).cast("long") for x in h] + [F.ceil(x).cast("long") for x in h]
    low = [F.element_at("_q", around.index(max(p - slack, 0.0)) + 1) for p in probs] * 2
    high = [F.element_at("_q", around.index(min(p + slack, 1.0)) + 1) for p in probs] * 2
    extreme = [F.when(r == 0, F.col("_least")).when(r == F.col("_n") - 1, F.col("_most")) for r in ranks]
    state = first.where("_n > 0").select(*keys, "_n", *[x for i in at for x in (
        ranks[i].alias(f"_r{i}"), low[i].alias(f"_lo{i}"), high[i].alias(f"_hi{i}"), F.lit(0).cast("long").alias(f"_b{i}"),
        extreme[i].alias(f"_a{i}"), extreme[i].isNotNull().alias(f"_ok{i}"))])
    state = materialize(state, "selection")
    open_ = " OR ".join(f"NOT _ok{i}" for i in at)
    for _ in range(MAX_PASSES):
        if state.where(open_).isEmpty():
            break
        v, counts = F.col("_v"), []
        for i in at:
            lo, hi, todo = F.col(f"_lo{i}"), F.col(f"_hi{i}"), ~F.col(f"_ok{i}")
            counts += [F.count_if(todo & (v < lo)).alias(f"_l{i}"), F.count_if(todo & (v <= lo)).alias(f"_m{i}"),
                       F.count_if(todo & (hi.isNull() | (v < hi))).alias(f"_u{i}"), F.count_if(todo & (hi.isNull() | (v <= hi))).alias(f"_w{i}"),
                       F.percentile_approx(F.when(todo & _inside(i), v), steps, accuracy).alias(f"_q{i}")]
        told = _with_state(d, state, keys).groupBy(*keys).agg(*counts)
        state = materialize(_narrowed(_with_state(state, told, keys), keys, at, few, pieces), "selection")
    else:
        raise RuntimeError("selection did not end; the values have no total order")
    # the few rows of each bracket, by distinct value
    rows = _with_state(d, state, keys)
    hits = F.array(*[F.when(F.col(f"_a{i}").isNull() & _inside(i), F.lit(i)) for i in at])
    values = rows.select(*keys, "_v", F.explode(F.array_compact(hits)).alias("_i")).groupBy(*keys, "_i", "_v").agg(F.count("*").alias("_here"))
    so_far = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    values = _with_state(values.withColumn("_to", F.sum("_here").over(so_far)), state, keys)
    place = F.element_at(F.array(*[F.col(f"_r{i}") - F.col(f"_b{i}") for i in at]), F.col("_i") + 1)
    found = values.where((place < F.col("_to")) & (place >= F.col("_to") - F.col("_here")))
    got = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(f"_g{i}") for i in at])
    s = _with_state(state, got, keys, "left")
    value = [F.coalesce(F.col(f"_a{i}"), F.col(f"_g{i}")) for i in at]
    return s.select(*keys, *[(value[j] + (x - F.floor(x)) * (value[j + m] - value[j])).alias(name) for j, (x, name) in enumerate(zip(h, names))])


def _inside(i: int) -> Column:
    v, lo, hi = F.col("_v"), F.col(f"_lo{i}"), F.col(f"_hi{i}")
    return (lo.isNull() | (v > lo)) & (hi.isNull() | (v < hi))


def _narrowed(s: DataFrame, keys: list[str], at: Sequence[int], few: int, pieces: int) -> DataFrame:
    """The next brackets. A bracket is open at both ends (null: no end); the
    counts say how many rows are below its ends (``_l``, ``_u``) and not
    above them (``_m``, ``_w``), so an end that is the wanted value itself is
    found out, however many rows share it."""
    out = []
    for i in at:
        r, lo, hi, l, m, u, w, q = (F.col(f"_{x}{i}") for x in ("r", "lo", "hi", "l", "m", "u", "w", "q"))
        old = F.col(f"_ok{i}")
        answer = F.when(old, F.col(f"_a{i}")).when((r >= l) & (r < m), lo).when((r >= u) & (r < w) & hi.isNotNull(), hi)
        left, right = r < l, r >= w
        c = u - m
        inside = (r >= m) & (r < u)
        step = (r - m).cast("double") / F.greatest(c, F.lit(1)) * pieces
        down, up = F.floor(step).cast("int"), F.ceil(step).cast("int")
        # one more piece to either side for the sketch's error; beyond them the old ends
        a = F.when(down < 1, lo).otherwise(F.element_at(q, F.greatest(down, F.lit(1))))
        z = F.when(up + 1 > pieces, hi).otherwise(F.element_at(q, F.least(up + 2, F.lit(pieces + 1))))
        stay = old | (inside & (c <= few)) | answer.isNotNull()
        out += [F.when(stay, lo).when(left, F.lit(None)).when(right, hi).otherwise(a).alias(f"_lo{i}"),
                F.when(stay, hi).when(left, lo).when(right, F.lit(None)).otherwise(z).alias(f"_hi{i}"),
                F.when(old, F.col(f"_b{i}")).otherwise(m).alias(f"_b{i}"), answer.alias(f"_a{i}"), stay.alias(f"_ok{i}")]
    return s.select(*keys, "_n", *[f"_r{i}" for i in at], *out)


def smallest(df: DataFrame, group: str, order: Column, key: str, take: DataFrame, name: str, few: int = FEW) -> DataFrame:
    """``df`` with a boolean ``name``: the row is among the first ``_take``
    (by ``take``: group, _take) of its group by (``order``, ``key``).
    ``order`` is an md5 (32 hex digits). Rows that agree in both are taken
    together or not at all, so they should not exist; null groups are a
    group."""
    d = df.withColumn("_h", order)
    state = materialize(take.select(group, F.col("_take").alias("_need"), F.lit("").alias("_p"), (F.col("_take") <= 0).alias("_ok")), "selection")
    for used in range(0, HASH_DIGITS, DIGITS):
        rows = _with_state(d.select(group, "_h"), state.where("NOT _ok"), [group]).where(F.col("_h").startswith(F.col("_p")))
        digits = rows.groupBy(group, F.substring("_h", 1, used + DIGITS).alias("_q")).agg(F.count("*").alias("_c"))
        w = Window.partitionBy(group).orderBy("_q").rowsBetween(Window.unboundedPreceding, 0)
        digits = _with_state(digits.withColumn("_to", F.sum("_c").over(w)), state, [group])
        # the digits of the last row to take
        step = (digits.where((F.col("_need") <= F.col("_to")) & (F.col("_need") > F.col("_to") - F.col("_c")))
                .select(group, (F.col("_need") - F.col("_to") + F.col("_c")).alias("_need"), F.col("_q").alias("_p"), (F.col("_c") <= few).alias("_ok")))
        whole = digits.groupBy(group).agg(F.max("_to").alias("_to"), F.max("_need").alias("_need")).where("_need > _to")  # all rows
        step = step.unionByName(whole.select(group, F.lit(-1).cast("long").alias("_need"), F.lit("~").alias("_p"), F.lit(True).alias("_ok")))
        state = materialize(state.where("_ok").unionByName(step), "selection")
        if state.where("NOT _ok").isEmpty():
            break
    rows = _with_state(d.select(group, "_h", F.col(key).alias("_key")), state.where("_need > 0"), [group]).where(F.col("_h").startswith(F.col("_p")))
    nth = F.row_number().over(Window.partitionBy(group).orderBy("_h", "_key"))
    border = rows.withColumn("_nth", nth).where(F.col("_nth") == F.col("_need")).select(group, F.struct("_h", "_key").alias("_last"))
    border = border.unionByName(state.where("_need = -1").select(group, F.lit(None).cast(border.schema["_last"].dataType).alias("_last")))
    border = border.withColumn("_all", F.col("_last").isNull()).withColumnRenamed(group, "_g")
    out = d.join(border, F.col(group).eqNullSafe(F.col("_g")), "left")
    inside = F.coalesce(F.col("_all"), F.lit(False)) | F.coalesce(F.struct(F.col("_h"), F.col(key).alias("_key")) <= F.col("_last"), F.lit(False))
    return out.withColumn(name, inside).drop("_h", "_g", "_last", "_all")
