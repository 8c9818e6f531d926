"""Statistics of sensor frames as long pixel tables: (view, y, x, r, g, b, depth_m, instance).

Everything is one or two aggregations by view, combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def instance_stats(pixels: DataFrame, width: int, height: int, outer: float = 0.05) -> DataFrame:
    """By view and instance: pixels, bounding box, fill ratio, share in the outer border, and the sides it touches."""
    bx, by = max(1, int(width * outer)), max(1, int(height * outer))
    edge = (F.col("x") < bx) | (F.col("x") >= width - bx) | (F.col("y") < by) | (F.col("y") >= height - by)
    s = pixels.groupBy("view", "instance").agg(
        F.count("*").alias("pixels"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg(edge.cast("int")).alias("outer_share")
    )
    box = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    sides = F.array_compact(F.array(*[F.when(c, n) for n, c in (("bottom", F.col("y1") == height - 1), ("left", F.col("x0") == 0), ("right", F.col("x1") == width - 1), ("top", F.col("y0") == 0))]))
    return s.withColumn("fill_ratio", F.col("pixels") / box).withColumn("sides", sides).withColumn("min_side", F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 1)


def colour_stats(pixels: DataFrame, bins: int = 16) -> DataFrame:
    """By view: share of the commonest colour bin, entropy of bins in bits, mean and population deviation of luminance."""
    step = 256 // bins
    code = (F.floor(F.col("r") / step) * bins + F.floor(F.col("g") / step)) * bins + F.floor(F.col("b") / step)
    light = 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")
    n = pixels.groupBy("view", code.alias("bin")).agg(F.count("*").alias("n"), F.sum(light).alias("s"), F.sum(light * light).alias("q"))
    t = n.groupBy("view").agg(F.sum("n").alias("t"), F.max("n").alias("m"), F.sum(F.col("n") * F.log2("n")).alias("e"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("t")
    return t.select("view", (F.col("m") / F.col("t")).alias("dominant_share"), (F.log2("t") - F.col("e") / F.col("t")).alias("entropy_bits"), mean.alias("light_mean"), F.sqrt(F.greatest(F.col("q") / F.col("t") - mean * mean, F.lit(0.0))).alias("light_std"))


def collision_stats(pixels: DataFrame, height: int, near: float = 0.4, structural: Column | None = None) -> DataFrame:
    """By view, over the top half: valid depths, near ones, and near ones that are no structure, with shares."""
    good = F.col("depth_m").isNotNull() & ~F.isnan("depth_m") & (F.col("depth_m") > 0)
    close = good & (F.col("depth_m") < near)
    thing = close & ~(structural if structural is not None else F.lit(False))
    s = pixels.where(F.col("y") < height // 2).groupBy("view").agg(F.count("*").alias("top_half"), F.count_if(good).alias("valid"), F.count_if(close).alias("near"), F.count_if(thing).alias("near_things"))
    return s.withColumn("near_share", F.try_divide("near", "valid")).withColumn("near_thing_share", F.try_divide("near_things", "valid"))


def context_stats(pixels: DataFrame, close: float = 0.8, border: int = 1, width: int = 8, height: int = 8) -> DataFrame:
    """By view: depth percentiles, close share, share of close border pixels, and the instance with most pixels (ties to the smaller)."""
    good = (F.col("depth_m") > 0) & ~F.isnan("depth_m")
    edge = (F.col("x") < border) | (F.col("x") >= width - border) | (F.col("y") < border) | (F.col("y") >= height - border)
    depth = F.when(good, F.col("depth_m"))
    s = pixels.groupBy("view").agg(
        *[F.percentile(depth, p / 100).alias(f"p{p}") for p in (10, 50, 90)],
        F.try_divide(F.count_if(good & (F.col("depth_m") < close)), F.count_if(good)).alias("close_share"),
        F.try_divide(F.count_if(good & edge & (F.col("depth_m") < close)), F.count_if(edge)).alias("enclosure"),
    )
    n = pixels.groupBy("view", "instance").agg(F.count("*").alias("n"))
    top = n.groupBy("view").agg(F.max(F.struct("n", (-F.col("instance")).alias("m"))).alias("t")).select("view", (-F.col("t.m")).alias("dominant"), F.col("t.n").alias("dominant_pixels"))
    return s.join(top, "view")


def category_stats(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """By view and label (labels: instance, label): pixels, instances, and the largest smaller side of one."""
    per = pixels.groupBy("view", "instance").agg(F.count("*").alias("n"), (F.least(F.max("x") - F.min("x"), F.max("y") - F.min("y")) + 1).alias("side"))
    return per.join(labels, "instance").groupBy("view", "label").agg(F.sum("n").alias("pixels"), F.count("*").alias("instances"), F.max("side").alias("max_min_side"))


def pair_cue(pixels: DataFrame, a: int, b: int, least: int = 4, gap: float = 1.0) -> DataFrame:
    """By view: which of two instances lies left, if both are large enough and their centres far enough apart."""
    at = lambda i: F.when(F.col("instance") == i, F.col("x"))
    s = pixels.groupBy("view").agg(F.count(at(a)).alias("na"), F.count(at(b)).alias("nb"), F.avg(at(a)).alias("xa"), F.avg(at(b)).alias("xb"))
    big = (F.col("na") >= least) & (F.col("nb") >= least) & (F.abs(F.col("xa") - F.col("xb")) >= gap)
    return s.where(big).select("view", F.when(F.col("xa") < F.col("xb"), "left_of").otherwise("right_of").alias("cue"))


def loop_diagnostics(first: DataFrame, last: DataFrame) -> DataFrame:
    """By view, over pixels of two frames: mean absolute difference, PSNR in dB (null if equal), correlation."""
    a, b = first.select("view", "y", "x", F.col("r").alias("a")), last.select("view", "y", "x", F.col("r").alias("b"))
    j = a.join(b, ["view", "y", "x"])
    d = F.col("a") - F.col("b")
    s = j.groupBy("view").agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.corr(F.col("a").cast("double"), F.col("b").cast("double")).alias("correlation"))
    return s.select("view", "mae", F.when(F.col("mse") > 0, 10 * F.log10(255.0 * 255.0 / F.col("mse"))).alias("psnr_db"), "correlation")


def sharpness(pixels: DataFrame) -> DataFrame:
    """By view: variance of the four-neighbour Laplacian of luminance inside the frame.

    Each pixel adds to its neighbours' sums, so no self-join is needed.
    """
    light = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    parts = F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), (light * k).alias("v"), F.lit(1).alias("n")) for dy, dx, k in ((0, 0, -4), (1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1))])
    lap = pixels.select("view", F.explode(parts).alias("p")).groupBy("view", "p.y", "p.x").agg(F.sum("p.v").alias("l"), F.count("*").alias("n")).where("n = 5")
    return lap.groupBy("view").agg(F.var_pop("l").alias("sharpness"))


def semantic(pixels: DataFrame, registry: DataFrame) -> DataFrame:
    """Pixels with the label of their instance (registry: instance, label; unknown: 'unlabelled')."""
    return pixels.join(registry, "instance", "left").withColumn("label", F.coalesce("label", F.lit("unlabelled")))


def renamed_instances(paths: DataFrame, objects: DataFrame) -> DataFrame:
    """Instance paths to the object whose path is the longest that holds them.

    paths: (instance, path); objects: (name, prefix). Each path offers all its
    prefixes to an equi-join.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    offered = paths.select("instance", F.explode(prefixes).alias("prefix"))
    return offered.join(objects, "prefix").groupBy("instance").agg(F.max_by("name", F.length("prefix")).alias("name"))


def ranked_views(stats: DataFrame, group: str, score: Column) -> DataFrame:
    """The view of the highest score of each group; ties to the smaller view."""
    nth = F.row_number().over(W.partitionBy(group).orderBy(score.desc(), "view"))
    return stats.withColumn("_n", nth).where("_n = 1").drop("_n")
