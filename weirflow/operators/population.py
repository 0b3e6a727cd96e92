"""Populations of oscillators and travelling waves: statistics of complex samples by group, and of phase maps by frame.

One aggregate of moments gives everything about a population's amplitude and phase. A frame's wave statistics come
from its mean wrapped steps between pixels, its critical points from the smoothed and up-sampled map.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import quotient
from ..plans.joins import same_join
from ..plans.store import checkpoint_folder
from .cosine import low_pass, up_sample
from .phasemap import cells, critical_points, gradient, turn


def description(df: DataFrame, re: str, im: str, by: Sequence[str] = (), size: str | None = None, directed: bool = False) -> DataFrame:
    """Statistics of the complex samples of each group, of which those with a null part are left out.

    n; amplitude, the mean magnitude; magnitude and phase of the mean; synchrony, their ratio, and kuramoto, that of
    unit vectors, both also as a circular deviation (_std) and synchrony as 1 / (1 - s) (_linear); dispersion, the
    fourth root of the covariance's determinant, its inverse precision, and concentration, amplitude over dispersion;
    phase_std and amplitude_std, deviations across and along the mean's direction, over its magnitude (_dispersion) and
    the inverse of that (_precision). What would divide by zero is null; with `directed` every sample must have a
    direction, and kuramoto is NaN where a zero has none. `size` names a column of magnitudes where they are known."""
    r, i = F.col(re).cast("double"), F.col(im).cast("double")
    size = F.col(size) if size else F.sqrt(r * r + i * i)
    rows = df.where(r.isNotNull() & i.isNotNull())
    over = lambda a, b: a / F.nullif(b, F.lit(0.0))
    part = quotient if directed else over
    made = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("_r"), F.avg(i).alias("_i"), F.avg(size).alias("amplitude"), F.avg(part(r, size)).alias("_ur"), F.avg(part(i, size)).alias("_ui"),
        F.var_pop(r).alias("_rr"), F.covar_pop(r, i).alias("_ri"), F.var_pop(i).alias("_ii"),
    )
    c = F.col
    made = made.withColumns({"magnitude": F.sqrt(c("_r") ** 2 + c("_i") ** 2), "phase": F.atan2("_i", "_r"), "kuramoto": F.sqrt(c("_ur") ** 2 + c("_ui") ** 2)})
    made = made.withColumns({"synchrony": over(c("magnitude"), c("amplitude")), "_c": over(c("_r"), c("magnitude")), "_s": over(c("_i"), c("magnitude"))})
    across = c("_s") ** 2 * c("_rr") - 2 * c("_s") * c("_c") * c("_ri") + c("_c") ** 2 * c("_ii")
    along = c("_c") ** 2 * c("_rr") + 2 * c("_s") * c("_c") * c("_ri") + c("_s") ** 2 * c("_ii")
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    made = made.withColumns({"dispersion": root(root(c("_rr") * c("_ii") - c("_ri") ** 2)), "phase_std": root(across), "amplitude_std": root(along)})
    spread = lambda x: F.when(F.isnan(x), x).when(x > 0, root(-2 * F.log(F.least(x, F.lit(1.0)))))
    return made.select(
        *by, "n", "amplitude", "magnitude", "phase", "synchrony", "kuramoto", spread(c("synchrony")).alias("synchrony_std"), spread(c("kuramoto")).alias("kuramoto_std"), over(F.lit(1.0), 1 - c("synchrony")).alias("synchrony_linear"),
        "dispersion", over(F.lit(1.0), c("dispersion")).alias("precision"), over(c("amplitude"), c("dispersion")).alias("concentration"), "phase_std", "amplitude_std",
        over(c("phase_std"), c("magnitude")).alias("phase_dispersion"), over(c("amplitude_std"), c("magnitude")).alias("amplitude_dispersion"),
        over(c("magnitude"), c("phase_std")).alias("phase_precision"), over(c("magnitude"), c("amplitude_std")).alias("amplitude_precision"),
    )


def phase_velocity(df: DataFrame, unit: str, t: str, phase: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, t, velocity, coherence, n): median step of the units' phases to the next sample, and how much they share it.

    coherence is the mean cosine of the steps less their median; samples without a next one of their unit, at t + 1, have
    no step. A time's units are ranked together."""
    order = Window.partitionBy(*by, unit).orderBy(t)
    step = F.when(F.lead(t).over(order) == F.col(t) + 1, turn(F.lead(phase).over(order), F.col(phase)))
    rows = df.select(*by, unit, t, step.alias("_d")).where("_d is not null")
    middle = rows.groupBy(*by, t).agg(F.median("_d").alias("velocity"))
    both = same_join(rows, middle, [*by, t])
    return both.groupBy(*by, t, "velocity").agg(F.avg(F.cos(F.col("_d") - F.col("velocity"))).alias("coherence"), F.count(F.lit(1)).alias("n"))


def sliding_coherence(df: DataFrame, unit: str, t: str, re: str, im: str, length: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, t, coherence): amplitude-weighted agreement of the units' phase steps over Hann windows of `length` steps.

    At each time units agree by the cosine of their step less the median; a window's mean weighs times by the Hann
    function and units by their amplitude. t numbers the samples; the window is centred on t and cut at the ends."""
    order = Window.partitionBy(*by, unit).orderBy(t)
    phase = F.atan2(F.col(im), F.col(re))
    rows = df.select(*by, unit, t, phase.alias("_h"), F.sqrt(F.col(re) ** 2 + F.col(im) ** 2).alias("_a"))
    rows = rows.withColumn("_d", F.when(F.lead(t).over(order) == F.col(t) + 1, turn(F.lead("_h").over(order), F.col("_h")))).where("_d is not null")
    middle = rows.groupBy(*by, t).agg(F.median("_d").alias("_m"))
    both = same_join(rows, middle, [*by, t])
    sums = both.groupBy(*by, t).agg(F.sum(F.col("_a") * F.cos(F.col("_d") - F.col("_m"))).alias("_s"), F.sum("_a").alias("_w"))
    half = length // 2
    offsets = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(0.5 + 0.5 * math.cos(math.pi * k / (half + 1))).alias("w")) for k in range(-half, half + 1)))).alias("o")
    posted = sums.select(*by, F.col(t), "_s", "_w", offsets).select(*by, (F.col(t) + F.col("o.k")).alias(t), F.col("_s") * F.col("o.w"), F.col("_w") * F.col("o.w")).toDF(*by, t, "_s", "_w")
    there = posted.groupBy(*by, t).agg((F.sum("_s") / F.nullif(F.sum("_w"), F.lit(0.0))).alias("coherence"))
    return same_join(there, sums.select(*by, t), [*by, t], "left_semi")


def wave_statistics(frames: DataFrame, by: str, value: str = "value", spacing: float = 1.0, threshold: float = 0.5, rate: float | None = None) -> DataFrame:
    """Statistics of a phase map for each frame: gradients in cycles a unit of length, pixels being `spacing` apart.

    local is the mean magnitude of the gradient, planar the magnitude of its mean, sigma the magnitudes' deviation (radians
    a pixel) and cv that over their mean; pgd = planar / local and kuramoto_pgd, of unit vectors, tell a plane wave (1),
    both with circular deviations; wavelengths are inverse gradients. With a `rate` of frames, frequency is the median
    step to the next frame (numbers of `by`) and speeds are frequency over gradient. Columns ending in _above are null
    where pgd is under `threshold`."""
    made = gradient(cells(frames, value, [by]))
    size = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    unit = lambda c: F.avg(F.col(c) / F.nullif(F.col("_g"), F.lit(0.0)))
    rows = made.withColumn("_g", size).groupBy(by).agg(F.avg("dx").alias("_x"), F.avg("dy").alias("_y"), F.avg("_g").alias("_m"), F.stddev_pop("_g").alias("sigma"), unit("dx").alias("_ux"), unit("dy").alias("_uy"))
    over = lambda a, b: a / F.nullif(b, F.lit(0.0))
    plane = F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2)
    rows = rows.withColumns({"local": F.col("_m") / (2 * math.pi * spacing), "planar": plane / (2 * math.pi * spacing), "cv": over(F.col("sigma"), F.col("_m")), "pgd": over(plane, F.col("_m")), "kuramoto_pgd": F.sqrt(F.col("_ux") ** 2 + F.col("_uy") ** 2), "direction": F.atan2("_y", "_x")})
    spread = lambda c: F.when(F.col(c) > 0, F.sqrt(-2 * F.log(F.least(F.col(c), F.lit(1.0)))))
    rows = rows.withColumns({"pgd_std": spread("pgd"), "kuramoto_pgd_std": spread("kuramoto_pgd"), "wavelength_local": over(F.lit(1.0), F.col("local")), "wavelength": over(F.lit(1.0), F.col("planar"))})
    above = F.col("pgd") >= threshold
    rows = rows.withColumns({"planar_above": F.when(above, F.col("planar")), "wavelength_above": F.when(above, F.col("wavelength"))}).drop("_x", "_y", "_m", "_ux", "_uy")
    if rate is None:
        return rows
    now = frames.where(F.col(value).isNotNull()).select(by, "row", "col", F.col(value).alias("_p"))
    then = now.select((F.col(by) - 1).alias(by), "row", "col", F.col("_p").alias("_q"))
    steps = now.join(then, [by, "row", "col"]).groupBy(by).agg((F.median(turn(F.col("_q"), F.col("_p"))) * rate / (2 * math.pi)).alias("frequency"))
    rows = rows.join(steps, by, "left").withColumns({"speed_local": over(F.col("frequency"), F.col("local")), "speed": over(F.col("frequency"), F.col("planar"))})
    return rows.withColumn("speed_above", F.when(F.col("pgd") >= threshold, F.col("speed")))


def critical_counts(frames: DataFrame, by: str, re: str, im: str, cutoff: float | None = None, spacing: float = 1.0, factor: int = 3) -> DataFrame:
    """(by, clockwise, anticlockwise, saddle, maximum, minimum): critical points of each frame of complex pixels.

    Real and imaginary parts are low-passed (if there is a `cutoff`) and up-sampled before their phase is taken."""
    kinds = ("clockwise", "anticlockwise", "saddle", "maximum", "minimum")
    parts = []
    for c in (re, im):
        grid = frames.select(by, "row", "col", F.col(c).alias("value"))
        grid = grid if cutoff is None else low_pass(grid, cutoff, spacing, by=[by])
        parts.append(up_sample(grid, factor, [by]).withColumnRenamed("value", f"_{len(parts)}"))
    checkpoint_folder(frames.sparkSession)
    phases = parts[0].join(parts[1], [by, "row", "col"]).select(by, "row", "col", F.atan2("_1", "_0").alias("value")).checkpoint()
    found = critical_points(phases, by=[by]).groupBy(by).agg(*(F.sum((F.col("kind") == k).cast("long")).alias(k) for k in kinds))
    return frames.select(by).distinct().join(found, by, "left").fillna(0, list(kinds))
