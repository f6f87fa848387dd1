"""Exact order statistics and quantiles without a single-task merge.

Spark's exact ``percentile`` keeps a value->count map per group and merges
it in one task, and a rank window over a whole column sorts it in one task.
Neither survives a column of 10^12 values or a group holding a third of
the rows. Here the k-th smallest value is found by selection:

1. one aggregate per group: ``count`` and a ``percentile_approx`` grid
   (rank error <= n / ACCURACY);
2. from the grid, a bracket [lo, hi] that must contain rank k; one
   aggregate counts rows below and inside it (and proves the bracket);
3. while a bracket is still larger than ``cap`` rows, re-sketch only the
   bracket rows (each round shrinks it ~GRID / (2*MARGIN+1) times);
4. the final bracket is reduced to distinct values with counts
   (partial aggregation, so hot values collapse map-side) and a running
   sum over those few values picks the exact k-th value.

Targets are joined to the data on the group keys; when the target table is
small (size checked by a count) it is broadcast, otherwise the join
shuffles on the group keys and AQE splits skewed groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.session import cut_lineage

GRID = 100
ACCURACY = 10000
MARGIN = 2  # grid steps around the nominal position (>= 2*GRID/ACCURACY + 1)
BRACKET_SHARE = (2 * MARGIN + 2) / GRID  # rows a first bracket can hold, as a share of n
BROADCAST_TARGETS = 100_000


def _grid_probs() -> list[float]:
    return [j / GRID for j in range(GRID + 1)]


def _bounds_from_grid(k, m):
    """Grid index range around relative rank k (0-based) of m values."""
    pos = (k.cast("double") + 1.0) / m.cast("double") * GRID
    j_lo = F.floor(pos).cast("int") - MARGIN
    j_hi = F.ceil(pos).cast("int") + MARGIN
    return j_lo, j_hi


def _pick(qarr, j):
    # element_at is 1-based; outside the grid -> unbounded (NULL)
    return F.when((j >= 0) & (j <= GRID), F.element_at(qarr, j + 1))


def _join_targets(data: DataFrame, tg: DataFrame, keys: list[str], small: bool) -> DataFrame:
    if keys:
        return data.join(F.broadcast(tg) if small else tg, on=keys, how="inner")
    # global statistics: the target table has a handful of rows (checked),
    # so a broadcast on a constant key costs no shuffle
    d = data.withColumn("_g", F.lit(0))
    t = tg.withColumn("_g", F.lit(0))
    return d.join(F.broadcast(t), on="_g", how="inner").drop("_g")


def _in_bracket(v, lo, hi):
    cond = F.lit(True)
    cond = F.when(lo.isNull(), cond).otherwise(v >= lo)
    return cond & F.when(hi.isNull(), F.lit(True)).otherwise(v <= hi)


def order_statistics(data: DataFrame, keys: list[str], value: str, targets_fn,
                     cap: int = 2_000_000, max_rounds: int = 8) -> DataFrame:
    """Exact k-th smallest non-null ``value`` per group.

    ``targets_fn(counts)`` receives a DataFrame ``keys + [n]`` and returns
    ``keys + [tid, k]`` (k 0-based, 0 <= k < n). The result has
    ``keys + [tid, value, n, below, eq]``: the value, the group's non-null count, and how many
    values are strictly below / equal to it.
    """
    d = data.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    probs = _grid_probs()

    # round 1: one sketch per group, shared by all its targets
    sk = d.groupBy(*keys).agg(F.count("_v").alias("n"),
                              F.percentile_approx("_v", probs, ACCURACY).alias("_q"))
    sk = sk.cache()
    tg = targets_fn(sk.select(*keys, "n"))
    tg = tg.join(sk, on=keys, how="inner") if keys else _attach_global(tg, sk)
    # state per target: lo/hi bracket (NULL = unbounded), k relative to bracket, m rows in bracket
    tg = tg.select(*keys, "tid", F.col("k").cast("long").alias("k"), F.col("n").alias("m"),
                   F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
                   "_q", F.col("n").alias("_n"), F.col("k").cast("long").alias("_k0"))
    tg = tg.cache()
    size = tg.agg(F.count(F.lit(1)).alias("t"), F.max("_n").alias("mx")).first()
    n_targets, max_n = int(size["t"]), int(size["mx"] or 0)
    small = (not keys) or n_targets <= BROADCAST_TARGETS

    if max_n * BRACKET_SHARE + 2.0 * max_n / ACCURACY + 2 <= cap:
        # fast path: one pass counts the rows below each bracket (as a sentinel group) and
        # ranks the few distinct values inside it; targets it cannot prove fall back below
        j_lo, j_hi = _bounds_from_grid(F.col("k"), F.col("m"))
        one = tg.select(*keys, "tid", "k", "_n", "_k0", _pick(F.col("_q"), j_lo).alias("lo"),
                        _pick(F.col("_q"), j_hi).alias("hi"))
        res = _final(d, one, keys, small, with_below=True)
        if small:
            # the answer has one row per target and the target count is checked: collect it
            rows = res.collect()
            if len(rows) == n_targets:
                return data.sparkSession.createDataFrame(rows, res.schema)
        else:
            res = res.cache()
            if res.count() == n_targets:
                return res
            res.unpersist()

    prev_max = None
    for _ in range(max_rounds):
        j_lo, j_hi = _bounds_from_grid(F.col("k"), F.col("m"))
        cand = tg.select(*keys, "tid", "k", "m", "lo", "hi", "_n", "_k0",
                         _pick(F.col("_q"), j_lo).alias("nlo"),
                         _pick(F.col("_q"), j_hi).alias("nhi"))
        cand = cand.cache()
        joined = _join_targets(d, cand, keys, small)
        inside_old = _in_bracket(F.col("_v"), F.col("lo"), F.col("hi"))
        below_new = F.when(F.col("nlo").isNull(), F.lit(False)).otherwise(F.col("_v") < F.col("nlo"))
        inside_new = _in_bracket(F.col("_v"), F.col("nlo"), F.col("nhi"))
        cnt = (joined.where(inside_old)
               .groupBy(*keys, "tid")
               .agg(F.count_if(below_new).alias("below"),
                    F.count_if(inside_new).alias("inb")))
        nxt = cand.join(cnt, on=keys + ["tid"], how="left").fillna(0, subset=["below", "inb"])
        valid = (F.col("below") <= F.col("k")) & (F.col("below") + F.col("inb") > F.col("k"))
        nxt = nxt.select(
            *keys, "tid", "_n", "_k0",
            F.when(valid, F.col("k") - F.col("below")).otherwise(F.col("k")).alias("k"),
            F.when(valid, F.col("inb")).otherwise(F.col("m")).alias("m"),
            F.when(valid, F.col("nlo")).otherwise(F.col("lo")).alias("lo"),
            F.when(valid, F.col("nhi")).otherwise(F.col("hi")).alias("hi"),
            valid.alias("_progress"))
        # the per-target state is tiny; cutting its lineage keeps the plan from doubling per round
        nxt = cut_lineage(nxt)
        summary = nxt.agg(F.max("m").alias("mx"), F.max(F.col("_progress").cast("int")).alias("pg")).first()
        cand.unpersist()
        tg = nxt.drop("_progress")
        if summary["mx"] is None or summary["mx"] <= cap or not summary["pg"] or summary["mx"] == prev_max:
            break
        prev_max = summary["mx"]
        # refine: re-sketch only the rows inside each (large) bracket
        joined = _join_targets(d, tg, keys, small)
        rsk = (joined.where(_in_bracket(F.col("_v"), F.col("lo"), F.col("hi")))
               .groupBy(*keys, "tid")
               .agg(F.percentile_approx("_v", probs, ACCURACY).alias("_q")))
        tg = cut_lineage(tg.join(rsk, on=keys + ["tid"], how="left"))

    return _final(d, tg.select(*keys, "tid", "k", "_n", "_k0", "lo", "hi"), keys, small, with_below=False)


def _final(d: DataFrame, t: DataFrame, keys: list[str], small: bool, with_below: bool) -> DataFrame:
    """Exact pick inside the brackets: distinct values with counts, running sum per target.

    With ``with_below`` the rows under the bracket form one sentinel group (-inf), so the
    running sum gives absolute ranks; otherwise ``k`` is already relative to the bracket.
    """
    joined = _join_targets(d, t, keys, small)
    v, lo, hi = F.col("_v"), F.col("lo"), F.col("hi")
    if with_below:
        below = F.when(lo.isNull(), F.lit(False)).otherwise(v < lo)
        keep = below | _in_bracket(v, lo, hi)
        val = F.when(below, F.lit(float("-inf"))).otherwise(v)
    else:
        keep = _in_bracket(v, lo, hi)
        val = v
    vals = (joined.where(keep).select(*keys, "tid", "k", "_n", "_k0", val.alias("_v"))
            .groupBy(*keys, "tid", "k", "_n", "_k0", "_v").agg(F.count(F.lit(1)).alias("c")))
    w = Window.partitionBy(*keys, "tid").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    vals = vals.withColumn("_cum", F.sum("c").over(w))
    hit = vals.where((F.col("_cum") - F.col("c") <= F.col("k")) & (F.col("k") < F.col("_cum"))
                     & (F.col("_v") != F.lit(float("-inf"))))
    # rows strictly below the value (absolute) and rows equal to it
    below = F.col("_k0") - F.col("k") + F.col("_cum") - F.col("c")
    return hit.select(*keys, "tid", F.col("_v").alias("value"), F.col("_n").alias("n"), below.alias("below"),
                      F.col("c").alias("eq"))


def _attach_global(tg: DataFrame, sk: DataFrame) -> DataFrame:
    t = tg.withColumn("_g", F.lit(0))
    s = sk.withColumn("_g", F.lit(0))
    return t.join(F.broadcast(s), on="_g", how="inner").drop("_g")


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    by: list[str] | None = None, long_input: bool = False, cap: int = 2_000_000) -> DataFrame:
    """Linear-interpolated quantiles (pandas / DuckDB ``quantile_cont`` semantics).

    Returns long form ``by + [column_name, p, value]``; NULL-free groups only.
    With ``long_input`` the frame already has ``by + [column_name, _x]``.
    """
    by = list(by or [])
    if not by and not long_input:
        fast = global_quantiles(df, cols, probs, cap=cap)
        if fast is not None:
            rows = [(c, p, v) for c in cols for p, v in fast[c].items()]
            return df.sparkSession.createDataFrame(rows, "column_name string, p double, value double")
    if long_input:
        long = df
    elif len(cols) == 1:
        long = df.select(*by, F.lit(cols[0]).alias("column_name"), F.col(cols[0]).cast("double").alias("_x"))
    else:
        wide = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
        long = wide.unpivot(by, cols, "column_name", "_x")
    keys = by + ["column_name"]
    plist = list(probs)

    def targets(counts: DataFrame) -> DataFrame:
        arr = F.array(*[F.lit(float(p)) for p in plist])
        t = counts.select(*keys, "n", F.posexplode(arr).alias("pi", "p"))
        pos = F.col("p") * (F.col("n") - 1)
        t = t.select(*keys, "pi", "p", pos.alias("pos"),
                     F.floor(pos).cast("long").alias("k0"), F.ceil(pos).cast("long").alias("k1"))
        lo = t.select(*keys, (F.col("pi") * 2).alias("tid"), F.col("k0").alias("k"))
        hi = t.select(*keys, (F.col("pi") * 2 + 1).alias("tid"), F.col("k1").alias("k"))
        return lo.unionByName(hi)

    stats = order_statistics(long, keys, "_x", targets, cap=cap)
    lo = stats.where(F.col("tid") % 2 == 0).select(*keys, (F.col("tid") / 2).cast("int").alias("pi"),
                                                     F.col("value").alias("v0"), "n")
    hi = stats.where(F.col("tid") % 2 == 1).select(*keys, ((F.col("tid") - 1) / 2).cast("int").alias("pi"),
                                                     F.col("value").alias("v1"))
    parr = F.array(*[F.lit(float(p)) for p in plist])
    out = lo.join(hi, on=keys + ["pi"]).withColumn("p", F.element_at(parr, F.col("pi") + 1))
    pos = F.col("p") * (F.col("n") - 1)
    frac = pos - F.floor(pos)
    value = F.col("v0") + frac * (F.col("v1") - F.col("v0"))
    return out.select(*keys, "p", F.when(frac == 0, F.col("v0")).otherwise(value).alias("value"))


# probe offsets (in units of 1/ACCURACY) around each wanted probability; after the count is
# known the tightest offset whose bracket the sketch's error bound guarantees is used
PROBE_STEPS = (2, 4, 16, 64, 256, 1024, 4096)
COLLECT_CAP = 1_000_000  # bracket rows (bound from n) a global pick may bring to the driver
# per-task state of the two-job paths: one sketch per column / subset and one struct per target and
# row; wider requests go to the grouped selector, which shuffles by group instead
MAX_SKETCHES = 64
MAX_TARGETS = 256


def _pos(p: float, n: int) -> tuple[int, int, float]:
    pos = p * (n - 1)
    k0 = int(pos // 1)
    return k0, min(k0 + 1, n - 1) if pos > k0 else k0, pos - k0


def global_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                     cap: int = COLLECT_CAP) -> dict[str, dict[float, float]] | None:
    """Exact global quantiles in two jobs, or None when the bracket cannot be proven small.

    Job 1 is one aggregate: the non-null count and a ladder of ``percentile_approx`` probes
    around every p. Job 2 is one grouped count over the values inside each bracket (rows below a
    bracket collapse to one flagged group per target), collected only when its size bound
    ``2 * (d + 1/ACCURACY) * n + 3`` rows per target is below ``COLLECT_CAP``; targets that pass it only
    together are collected in several rounds. The pick itself
    uses the counts, so a bracket that misses its ranks is detected and the caller falls back
    to the distributed selector.
    """
    probs = [float(p) for p in probs]
    if not cols or not probs:
        return {c: {} for c in cols}
    if len(cols) > MAX_SKETCHES or len(cols) * len(probs) > MAX_TARGETS:
        return None
    ladder = sorted({min(1.0, max(0.0, p + s * d / ACCURACY)) for p in probs for d in PROBE_STEPS
                     for s in (-1, 1)} | set(probs))
    x = {c: F.col(f"`{c}`").cast("double") for c in cols}
    r = df.agg(*[a for i, c in enumerate(cols) for a in (
        F.count(x[c]).alias(f"n{i}"), F.percentile_approx(x[c], ladder, ACCURACY).alias(f"q{i}"))]).first()
    at = {q: j for j, q in enumerate(ladder)}

    targets, total, rounds = [], 0, 0  # (column index, p, lo or None, hi or None, n, round)
    for i, c in enumerate(cols):
        n = int(r[f"n{i}"])
        if n == 0:
            continue
        grid = r[f"q{i}"]
        for p in probs:
            # smallest offset with (d - 1/ACCURACY) * n >= 2 brackets ranks floor/ceil(p(n-1))
            d = next((d for d in PROBE_STEPS if (d - 1) * n >= 2 * ACCURACY), None)
            if d is None:
                lo = hi = None
                bound = n
            else:
                lo_q, hi_q = max(0.0, p - d / ACCURACY), min(1.0, p + d / ACCURACY)
                lo = grid[at[lo_q]] if lo_q > 0.0 else None
                hi = grid[at[hi_q]] if hi_q < 1.0 else None
                bound = 2 * (d + 1) * n / ACCURACY + 3
            if bound > min(cap, COLLECT_CAP):
                return None
            total += bound  # what a round's targets bring to the driver together
            if total > COLLECT_CAP:
                total, rounds = bound, rounds + 1
            targets.append((i, p, lo, hi, n, rounds))
    out: dict[str, dict[float, float]] = {c: {} for c in cols}
    if not targets:
        return out

    elems: list[list] = [[] for _ in range(rounds + 1)]
    for t, (i, _, lo, hi, _, _) in enumerate(targets):
        v = x[cols[i]]
        inside = v.isNotNull()
        if lo is not None:
            inside = inside & (v >= F.lit(lo))
        if hi is not None:
            inside = inside & (v <= F.lit(hi))
        e = F.when(inside, F.struct(F.lit(t).alias("t"), F.lit(False).alias("b"), v.alias("v")))
        if lo is not None:
            e = F.when(v < F.lit(lo), F.struct(F.lit(t).alias("t"), F.lit(True).alias("b"),
                                               F.lit(None).cast("double").alias("v"))).otherwise(e)
        elems[targets[t][5]].append(e)
    for turn, some in enumerate(elems):
        # explode then a plain filter: both stay in whole-stage codegen (a lambda filter would not)
        counts = (df.select(F.explode(F.array(*some)).alias("e")).where(F.col("e").isNotNull())
                  .select("e.t", "e.b", "e.v")
                  .groupBy("t", "b", "v").agg(F.count(F.lit(1)).alias("c")).collect())
        below = [0] * len(targets)
        vals: list[list[tuple[float, int]]] = [[] for _ in targets]
        for row in counts:
            if row["b"]:
                below[row["t"]] += row["c"]
            else:
                vals[row["t"]].append((row["v"], row["c"]))
        for t, (i, p, _, _, n, at_turn) in enumerate(targets):
            if at_turn != turn:
                continue
            k0, k1, frac = _pos(p, n)
            ordered = sorted(vals[t], key=lambda vc: (vc[0] != vc[0], vc[0]))  # NaN sorts last, as in Spark
            inside_n = sum(c for _, c in ordered)
            if not (below[t] <= k0 and k1 < below[t] + inside_n):
                return None

            def kth(k, ordered=ordered, base=below[t]):
                cum = base
                for v, c in ordered:
                    cum += c
                    if k < cum:
                        return v
            v0, v1 = kth(k0), kth(k1)
            out[cols[i]][round(p, 12)] = v0 if frac == 0 else v0 + frac * (v1 - v0)
    return out


def kth_many(df: DataFrame, value: str, targets: list[tuple], cap: int = COLLECT_CAP) -> list | None:
    """Exact k-th smallest non-null ``value`` for a few row subsets, in two jobs in total.

    ``targets`` is a bounded list of ``(condition, k, p_hint)``: the rows where ``condition`` holds,
    the 0-based rank and roughly k / n of that subset (known to the caller before the count). Job 1
    is one aggregate with a count and a probe ladder per target; job 2 is one grouped count of the
    values inside each bracket, collected under the same checked bound as ``global_quantiles``.
    Returns ``(value, rows strictly below it, rows equal to it)`` per target, or None when some
    bracket cannot be proven small (the caller then uses ``order_statistics``).
    """
    if not targets or len(targets) > MAX_SKETCHES:
        return None if targets else []
    x = F.col(f"`{value}`").cast("double")
    ladders = [sorted({min(1.0, max(0.0, p + s * d / ACCURACY)) for d in PROBE_STEPS for s in (-1, 1)})
               for _, _, p in targets]
    r = df.agg(*[a for t, ((cond, _, _), lad) in enumerate(zip(targets, ladders)) for a in (
        F.count(F.when(cond, x)).alias(f"n{t}"),
        F.percentile_approx(F.when(cond, x), lad, ACCURACY).alias(f"q{t}"))]).first()
    brackets, total = [], 0
    for t, ((cond, k, p), lad) in enumerate(zip(targets, ladders)):
        n = int(r[f"n{t}"])
        if not 0 <= k < n:
            return None
        # smallest offset whose probes are guaranteed to fall below / above 1-based rank k + 1
        d = next((d for d in PROBE_STEPS if (p - (d - 1) / ACCURACY) * n <= k
                  and (p + (d - 1) / ACCURACY) * n >= k + 2), None)
        if d is None:
            lo = hi = None
            bound = n
        else:
            at = {q: j for j, q in enumerate(lad)}
            lo_q, hi_q = max(0.0, p - d / ACCURACY), min(1.0, p + d / ACCURACY)
            lo = r[f"q{t}"][at[lo_q]] if lo_q > 0.0 else None
            hi = r[f"q{t}"][at[hi_q]] if hi_q < 1.0 else None
            bound = 2 * (d + 1) * n / ACCURACY + 3
        total += bound  # what all targets bring to the driver together
        if bound > cap or total > COLLECT_CAP:
            return None
        brackets.append((lo, hi))
    elems = []
    for t, ((cond, _, _), (lo, hi)) in enumerate(zip(targets, brackets)):
        inside = cond & x.isNotNull()
        if lo is not None:
            inside = inside & (x >= F.lit(lo))
        if hi is not None:
            inside = inside & (x <= F.lit(hi))
        e = F.when(inside, F.struct(F.lit(t).alias("t"), F.lit(False).alias("b"), x.alias("v")))
        if lo is not None:
            e = F.when(cond & (x < F.lit(lo)), F.struct(F.lit(t).alias("t"), F.lit(True).alias("b"),
                                                        F.lit(None).cast("double").alias("v"))).otherwise(e)
        elems.append(e)
    rows = (df.select(F.explode(F.array(*elems)).alias("e")).where(F.col("e").isNotNull())
            .select("e.t", "e.b", "e.v").groupBy("t", "b", "v").agg(F.count(F.lit(1)).alias("c")).collect())
    out = []
    for t, (_, k, _) in enumerate(targets):
        below = sum(rw["c"] for rw in rows if rw["t"] == t and rw["b"])
        ordered = sorted(((rw["v"], rw["c"]) for rw in rows if rw["t"] == t and not rw["b"]),
                         key=lambda vc: (vc[0] != vc[0], vc[0]))
        cum, hit = below, None
        for v, c in ordered:
            if k < cum + c:
                hit = (v, cum, c)
                break
            cum += c
        if hit is None or below > k:
            return None
        out.append(hit)
    return out


def global_kth(df: DataFrame, value: str, k: int, p_hint: float,
               cap: int = COLLECT_CAP) -> tuple[float, int, int] | None:
    """Exact k-th smallest (0-based) non-null ``value`` of a whole frame in two jobs (see ``kth_many``)."""
    res = kth_many(df, value, [(F.lit(True), k, p_hint)], cap)
    return None if res is None else res[0]


def quantile_dict(df: DataFrame, cols: list[str], probs: list[float],
                  exact: bool = True) -> dict[str, dict[float, float]]:
    """Global quantiles collected as ``{column: {p: value}}`` (small result).

    ``exact=False`` returns ``percentile_approx`` values (rank error <= n / ACCURACY) from one
    aggregate, for fits where an approximate bound is acceptable.
    """
    out: dict[str, dict[float, float]] = {c: {} for c in cols}
    if not cols:
        return out
    if not exact:
        r = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), list(probs), ACCURACY).alias(f"q{i}")
                     for i, c in enumerate(cols)]).first()
        for i, c in enumerate(cols):
            for p, v in zip(probs, r[f"q{i}"] or []):
                out[c][round(p, 12)] = v
        return out
    fast = global_quantiles(df, cols, probs)
    if fast is not None:
        return fast
    for r in exact_quantiles(df, cols, probs).collect():
        out[r["column_name"]][round(r["p"], 12)] = r["value"]
    return out


def kth_threshold(df: DataFrame, value: str, by: list[str], k_fn) -> DataFrame:
    """k-th smallest ``value`` per group where ``k_fn(n_column)`` gives k (0-based)."""
    def targets(counts: DataFrame) -> DataFrame:
        return counts.select(*by, F.lit(0).alias("tid"), k_fn(F.col("n")).cast("long").alias("k")) \
            .where((F.col("k") >= 0) & (F.col("k") < F.col("n")))
    res = order_statistics(df, by, value, targets)
    return res.select(*by, F.col("value").alias("threshold"))
