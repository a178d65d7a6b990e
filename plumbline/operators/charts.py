"""Chart data: bars, histograms, density curves, scatter pairs, heat map and the manifest."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import vocab
from plumbline.functions.scalars import one_place, safe_name, strength_words, two_places
from plumbline.operators.columns import ColumnInfo, columns_of
from plumbline.operators.correlation import corr_pairs, top_pairs
from plumbline.operators.frequency import value_frequencies
from plumbline.operators.quantiles import column_quantiles
from plumbline.session import small_table


#: Bins of a histogram at most; the bin number is an int.
MOST_BINS = 1 << 30
#: Cells of the grid of a binned density curve at most.
MOST_CELLS = 1 << 20


def chart_routes(facts: DataFrame) -> DataFrame:
    """Which chart each column gets: (ordinal, column, chart, place).

    Numeric columns with few values count as categories and come after the
    other categories. ``place`` is the position within the chart family.
    """
    few = (F.col("role") == "numeric") & (F.col("nunique") <= vocab.CATEGORICAL_MAX_DISTINCT)
    bar = F.col("role").isin("categorical", "datetime") | few
    chart = F.when(bar, "bar").otherwise("histogram")
    order = Window.partitionBy("chart").orderBy(F.when(few, 1).otherwise(0), "ordinal")
    return (
        facts.where("role <> 'unsupported'").withColumn("chart", chart)
        .select("ordinal", "column", "chart", F.row_number().over(order).alias("place"), "nunique", "n")
    )


def _picked(df: DataFrame, routes: DataFrame, keep: Column) -> list[ColumnInfo]:
    chosen = {r["ordinal"]: r["place"] for r in routes.where(keep).collect()}
    cols = [c for c in columns_of(df) if c.ordinal in chosen]
    return sorted(cols, key=lambda c: chosen[c.ordinal])


def bar_data(df: DataFrame, facts: DataFrame, max_columns: int | None = None, max_values: int | None = None) -> DataFrame:
    """Value counts of the bar-chart columns with rank and share.

    ``max_columns`` and ``max_values`` leave out later columns and columns with
    more values, for a display that has no room for them.
    """
    keep = (F.col("chart") == "bar") & (F.col("nunique") >= 1)
    if max_columns is not None:
        keep &= F.col("place") <= max_columns
    if max_values is not None:
        keep &= F.col("nunique") <= max_values
    cols = _picked(df, chart_routes(facts), keep)
    freq = value_frequencies(df, cols)
    rank = F.row_number().over(Window.partitionBy("ordinal").orderBy(F.desc("n"), "value"))
    total = F.sum("n").over(Window.partitionBy("ordinal"))
    return freq.select(
        "ordinal", "column", "value", "n", rank.alias("rk"), F.round(F.col("n") / total * 100, 4).alias("share"))


def histogram_columns(df: DataFrame, facts: DataFrame, max_columns: int | None = None) -> list[ColumnInfo]:
    keep = (F.col("chart") == "histogram") & (F.col("n") > 0)
    if max_columns is not None:
        keep &= F.col("place") <= max_columns
    return _picked(df, chart_routes(facts), keep)


def _axis(c: ColumnInfo, log: bool) -> Column:
    """Value on the chart's axis: itself, or its log10 where positive."""
    return F.when(c.number > 0, F.log10(c.number)) if log else c.number


def histogram_specs(
    df: DataFrame, facts: DataFrame, log_scale: bool | None = None, max_columns: int | None = None, max_bins: int = MOST_BINS
) -> DataFrame:
    """Binning of each histogram column: (ordinal, column, log_scale, n, lo, hi, bins, skew).

    A column whose skew proxy exceeds the limit is shown on a log axis
    (``log_scale`` forces the choice). The bin width is the smaller of the
    Sturges and Freedman-Diaconis widths, on the axis shown; far outliers make
    many bins of that width, of which only the filled ones are counted, and
    beyond ``max_bins`` the bins get wider.
    """
    cols = histogram_columns(df, facts, max_columns)
    spark = df.sparkSession
    stats = {r["ordinal"]: r for r in facts.select("ordinal", "n", "mean", "median", "std", "min", "max", "q1", "q3").collect()}
    rows, logged = [], []
    for c in cols:
        s = stats[c.ordinal]
        skew = abs(s["mean"] - s["median"]) / s["std"] if s["std"] else None
        log = (skew is not None and skew > vocab.SKEW_LIMIT) if log_scale is None else log_scale
        if log:
            logged.append((c, skew))
        else:
            rows.append((c.ordinal, c.name, False, s["n"], s["min"], s["max"], s["q1"], s["q3"], skew))
    if logged:
        axis = df.select(*[_axis(c, True).alias(f"x{i}") for i, (c, _) in enumerate(logged)])
        wide = axis.agg(*[
            f(F.col(f"x{i}")).alias(f"{k}{i}") for i in range(len(logged))
            for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
        extents = {i: (wide[f"n{i}"], wide[f"lo{i}"], wide[f"hi{i}"]) for i in range(len(logged))}
        found = column_quantiles(axis, columns_of(axis), (0.25, 0.75), extents)
        for i, (c, skew) in enumerate(logged):
            if i in found:
                rows.append((c.ordinal, c.name, True, *extents[i], *found[i], skew))
    table = small_table(
        spark, rows,
        "ordinal int, column string, log_scale boolean, n bigint, lo double, hi double, q1 double, q3 double, skew double")
    reach = F.col("hi") - F.col("lo")
    sturges = reach / (F.log2("n") + 1)
    fd = 2 * (F.col("q3") - F.col("q1")) / F.pow(F.col("n").cast("double"), F.lit(1 / 3))
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    bins = F.when(reach > 0, F.ceil(F.least(reach / width, F.lit(float(max_bins))))).otherwise(1).cast("int")
    return table.select("ordinal", "column", "log_scale", "n", "lo", "hi", bins.alias("bins"), "skew")


def histogram_data(df: DataFrame, specs: DataFrame) -> DataFrame:
    """Non-empty bins of every histogram: (ordinal, column, log_scale, bin, bin_from, bin_to, n).

    One scan for all columns; counts combine on the map side.
    """
    held = specs.collect()
    schema = "ordinal int, column string, log_scale boolean, bin int, bin_from double, bin_to double, n bigint"
    if not held:
        return small_table(df.sparkSession, [], schema)
    by_ordinal = {c.ordinal: c for c in columns_of(df)}
    cells = [_axis(by_ordinal[s["ordinal"]], s["log_scale"]) for s in held]
    index = small_table(
        df.sparkSession, [(i, *[s[k] for k in ("ordinal", "column", "log_scale", "lo", "hi", "bins")]) for i, s in enumerate(held)],
        "pos int, ordinal int, column string, log_scale boolean, lo double, hi double, bins int")
    reach = F.col("hi") - F.col("lo")
    spot = F.when(reach > 0, F.floor((F.col("v") - F.col("lo")) / reach * F.col("bins"))).otherwise(0)
    counted = (
        df.select(F.posexplode(F.array(*cells)).alias("pos", "v")).where(F.col("v").isNotNull())
        .join(F.broadcast(index), "pos")
        .groupBy("pos", F.least(spot, F.col("bins") - 1).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(index), "pos")
    )

    def edge(step: Column) -> Column:
        at = F.col("lo") + step * reach / F.col("bins")
        return F.when(F.col("log_scale"), F.pow(F.lit(10.0), at)).otherwise(at)

    return counted.select(
        "ordinal", "column", "log_scale", "bin", edge(F.col("bin")).alias("bin_from"),
        edge(F.col("bin") + 1).alias("bin_to"), "n")


def _density(width: Sequence[float], grids: Sequence[Sequence[float]]):
    """Per-task kernel sums on each column's grid."""
    grid = np.array(grids)
    h = np.array(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(grid.shape)
        for batch in batches:
            pos, v, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for p in np.unique(pos):
                mine = pos == p
                z = (grid[p][:, None] - v[mine][None, :]) / h[p]
                sums[p] += np.exp(-0.5 * z * z) @ n[mine]
        p, g = np.indices(grid.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.ravel().astype("int32")), pa.array(g.ravel().astype("int32")), pa.array(sums.ravel())],
            names=["pos", "point", "s"])

    return run


def density_curves(
    df: DataFrame, specs: DataFrame, points: int = vocab.DENSITY_POINTS, cells_per_width: int | None = None
) -> DataFrame:
    """Gaussian kernel density of each histogram column on an even grid, Scott bandwidth.

    Equal values are counted first; each task then reduces its values to one
    sum per grid point. With ``cells_per_width``, values are first shared out to
    the two nearest knots of an even grid with so many cells to a bandwidth
    (never more than MOST_CELLS), so that a task sends at most the grid,
    whatever the values; the curve differs by less than 1 / (8 cells²) of its
    height at the kernel's scale.
    """
    held = [s for s in specs.collect() if s["n"] > 1 and s["hi"] > s["lo"]]
    spark = df.sparkSession
    if not held:
        return small_table(spark, [], "ordinal int, column string, point int, x double, density double")
    by_ordinal = {c.ordinal: c for c in columns_of(df)}
    cells = [_axis(by_ordinal[s["ordinal"]], s["log_scale"]) for s in held]
    flat = df.select(*[c.alias(f"x{i}") for i, c in enumerate(cells)])
    deviation = flat.agg(*[F.stddev_samp(f"x{i}").alias(f"d{i}") for i in range(len(held))]).first()
    widths = [float(deviation[f"d{i}"] * s["n"] ** (-1 / 5)) for i, s in enumerate(held)]
    grids = [np.linspace(s["lo"], s["hi"], points).tolist() for s in held]
    tall = flat.select(F.posexplode(F.array(*[f"x{i}" for i in range(len(held))])).alias("pos", "v")).where(F.col("v").isNotNull())
    if cells_per_width is None:
        counted = tall.groupBy("pos", "v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    else:
        counted = _shared_out(tall, [s["lo"] for s in held], [
            (s["hi"] - s["lo"]) / min(MOST_CELLS, math.ceil(cells_per_width * (s["hi"] - s["lo"]) / h)) for s, h in zip(held, widths)])
    sums = counted.mapInArrow(_density(widths, grids), "pos int, point int, s double").groupBy("pos", "point").agg(
        F.sum("s").alias("s"))
    index = small_table(
        spark,
        [(i, p, s["ordinal"], s["column"], s["log_scale"], float(s["n"]), widths[i], grids[i][p])
         for i, s in enumerate(held) for p in range(points)],
        "pos int, point int, ordinal int, column string, log_scale boolean, total double, width double, at double")
    scale = F.col("total") * F.col("width") * F.lit(float(np.sqrt(2 * np.pi)))
    x = F.when(F.col("log_scale"), F.pow(F.lit(10.0), F.col("at"))).otherwise(F.col("at"))
    return sums.join(F.broadcast(index), ["pos", "point"]).select(
        "ordinal", "column", "point", x.alias("x"), (F.col("s") / scale).alias("density"))


def _shared_out(tall: DataFrame, lows: Sequence[float], steps: Sequence[float]) -> DataFrame:
    """(pos, v, n): the weight of each knot when every value is shared between the two knots around it."""
    low, step = (F.get(F.array(*map(F.lit, x)), F.col("pos")) for x in (lows, steps))
    at = (F.col("v") - low) / step
    knots = F.array(F.struct(F.floor(at).alias("knot"), (1 - (at - F.floor(at))).alias("w")),
                    F.struct((F.floor(at) + 1).alias("knot"), (at - F.floor(at)).alias("w")))
    return tall.select("pos", F.inline(knots)).groupBy("pos", "knot").agg(F.sum("w").alias("n")).select(
        "pos", (low + F.col("knot") * step).alias("v"), "n")


def _continuous(df: DataFrame, facts: DataFrame) -> list[ColumnInfo]:
    return _picked(df, chart_routes(facts), F.col("chart") == "histogram")


def continuous_pairs(df: DataFrame, facts: DataFrame) -> DataFrame:
    """Correlation pairs of the continuous numeric columns."""
    return corr_pairs(df, _continuous(df, facts), facts)


def scatter_pairs(pairs: DataFrame) -> DataFrame:
    """The scatter-plot pairs with r and its wording."""
    top = top_pairs(pairs)
    return top.select("a", "b", "r", strength_words(F.col("r")).alias("relationship"))


def scatter_points(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """All complete points of the scatter pairs, long: (a, b, x, y)."""
    held = [(r["a"], r["b"]) for r in pairs.collect()]
    by_name = {c.name: c for c in columns_of(df)}
    if not held:
        return small_table(df.sparkSession, [], "a string, b string, x double, y double")
    cells = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), by_name[a].number.alias("x"), by_name[b].number.alias("y"))
        for a, b in held])
    return df.select(F.inline(cells)).where(F.col("x").isNotNull() & F.col("y").isNotNull())


def heatmap_data(df: DataFrame, facts: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Both triangles and diagonal of r over continuous, not nearly unique columns: (a, b, r)."""
    pairs = continuous_pairs(df, facts) if pairs is None else pairs
    names = [r["column"] for r in _heatmap_columns(facts).collect()]
    if len(names) < 2:
        return small_table(df.sparkSession, [], "a string, b string, r double")
    upper = pairs.where(F.col("a").isin(names) & F.col("b").isin(names)).select("a", "b", F.round("r", 4).alias("r"))
    diagonal = small_table(df.sparkSession, [(n, n, 1.0) for n in names], "a string, b string, r double")
    return upper.unionByName(upper.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).unionByName(diagonal)


def _heatmap_columns(facts: DataFrame) -> DataFrame:
    unique = F.col("nunique") / F.col("n") > vocab.HEATMAP_UNIQUENESS
    return chart_routes(facts).where((F.col("chart") == "histogram") & (F.col("n") > 0) & ~unique).select("column")


def chart_manifest(facts: DataFrame, bars: DataFrame, specs: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per chart: (ordinal, chart_type, chart_id, title, description, interpretation)."""
    c = F.col
    quoted = F.concat(F.lit("'"), c("column"), F.lit("'"))
    sizes = bars.groupBy("ordinal").agg(F.count(F.lit(1)).alias("k"))
    routes = chart_routes(facts).select("ordinal", "place")

    def chart(rows: DataFrame, family: int, kind: str, place: Column, ident: Column, title: Column,
              description: Column, interpretation: Column) -> DataFrame:
        return rows.select(
            F.lit(family).alias("family"), place.alias("place"), F.lit(kind).alias("chart_type"),
            safe_name(ident).alias("chart_id"), title.alias("title"), description.alias("description"),
            interpretation.alias("interpretation"))

    bar = chart(
        bars.where("rk = 1").join(sizes, "ordinal").join(routes, "ordinal"), 1, "bar", c("place"),
        F.concat(F.lit("bar_chart_"), c("column")), F.concat(F.lit("Frequency of "), quoted),
        F.concat(F.lit("Count of each category in "), quoted, F.lit(" ("), c("k").cast("string"), F.lit(" categories shown).")),
        F.concat(F.lit("'"), c("value"), F.lit("' is the most common value, appearing "), c("n").cast("string"),
                 F.lit(" times ("), one_place(c("share")), F.lit("% of rows).")))
    measure = F.concat(F.lit("(skew measure "), two_places(c("skew")), F.lit(")"))
    hist = chart(
        specs.join(routes, "ordinal"), 2, "histogram", c("place"), F.concat(F.lit("histogram_"), c("column")),
        F.concat(F.lit("Distribution of "), quoted),
        F.concat(F.lit("Distribution of "), quoted, F.lit(" across all rows with a non-null value.")),
        F.when(c("skew").isNull(), F.concat(quoted, F.lit(" has zero variance in the non-null values shown.")))
        .when(c("log_scale"), F.concat(quoted, F.lit(" is right-skewed "), measure, F.lit(", so this is shown on a log scale.")))
        .otherwise(F.concat(quoted, F.lit(" is roughly symmetric "), measure, F.lit("."))))
    both = F.concat(F.lit("'"), c("a"), F.lit("' vs '"), c("b"), F.lit("'"))
    order = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.abs("r")), "a", "b"))
    scatter = chart(
        scatter_pairs(pairs).withColumn("place", order), 3, "scatter", c("place"),
        F.concat(F.lit("scatter_"), c("a"), F.lit("_vs_"), c("b")), both,
        F.concat(F.lit("Relationship between '"), c("a"), F.lit("' and '"), c("b"),
                 F.lit("', the numeric pair with one of the strongest correlations in this dataset.")),
        F.concat(F.lit("A "), c("relationship"), F.lit(" relationship (correlation "), two_places(c("r")), F.lit(").")))
    names = [r["column"] for r in _heatmap_columns(facts).collect()]
    out = bar.unionByName(hist).unionByName(scatter)
    if len(names) >= 2:
        inside = pairs.where(c("a").isin(names) & c("b").isin(names) & (F.abs("r") > 0))
        best = inside.agg(F.max_by(F.struct("a", "b", "r"), F.struct(F.abs("r"), -c("i"), -c("j"))).alias("p"))
        text = F.when(c("p").isNull(), F.lit("No strong pairwise correlations were found among these columns.")).otherwise(
            F.concat(F.lit("The strongest relationship is between '"), c("p.a"), F.lit("' and '"), c("p.b"),
                     F.lit("' (correlation "), two_places(c("p.r")), F.lit(").")))
        out = out.unionByName(chart(
            best, 4, "heatmap", F.lit(1), F.lit("correlation_heatmap"), F.lit("Correlation Matrix"),
            F.lit(f"Pairwise correlation across {len(names)} numeric columns."), text))
    ordinal = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("family", "place"))
    return out.select(ordinal.alias("ordinal"), "chart_type", "chart_id", "title", "description", "interpretation")
