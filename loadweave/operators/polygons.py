"""Points that stand for polygons: the centroid by area, or a point inside where the centroid is none.

A polygon is a table of vertices (code, ring, n, x, y); holes are rings of the other direction.  All
steps are sums over edges and crossings with one horizontal line for each polygon, so nothing but a
polygon's crossings is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How a point was found.
CENTROID, INSIDE, MEAN, FAILED = "면적중심", "내부점보정", "정점평균(면적0)", "면적중심(보정실패)"


def edges(vertices: DataFrame) -> DataFrame:
    """code, ring, x, y and the next vertex x1, y1 (after the last the first), of rings with at least 3 vertices."""
    ring = Window.partitionBy("code", "ring")
    along = ring.orderBy("n")
    known = vertices.where("x is not null and y is not null")
    out = known.select(
        "code", "ring", "x", "y", *[F.coalesce(F.lead(c).over(along), F.first(c).over(along)).alias(f"{c}1") for c in ("x", "y")],
        F.count("*").over(ring).alias("__size"),
    )
    return out.where("__size >= 3").drop("__size")


def ring_moments(sides: DataFrame) -> DataFrame:
    """code, ring, area (signed), mx and my (area times centroid), low and high y of every ring."""
    cross = F.col("x") * F.col("y1") - F.col("x1") * F.col("y")
    sums = sides.groupBy("code", "ring").agg(
        (F.sum(cross) / 2).alias("area"), F.sum((F.col("x") + F.col("x1")) * cross).alias("sx"), F.sum((F.col("y") + F.col("y1")) * cross).alias("sy"),
        F.min("y").alias("low"), F.max("y").alias("high"),
    )
    moment = lambda c: F.when(F.col("area") != 0, F.col(c) / 6).otherwise(0.0)
    return sums.select("code", "ring", "area", moment("sx").alias("mx"), moment("sy").alias("my"), "low", "high")


def crossings(sides: DataFrame, lines: DataFrame) -> DataFrame:
    """code and at: where the edges cross their polygon's line (lines: code, line; edges hold their lower end, not the upper)."""
    met = sides.join(lines, "code").where((F.col("y") > F.col("line")) != (F.col("y1") > F.col("line")))
    return met.select("code", (F.col("x") + (F.col("line") - F.col("y")) * (F.col("x1") - F.col("x")) / (F.col("y1") - F.col("y"))).alias("at"))


def widest(crossed: DataFrame) -> DataFrame:
    """code, middle and width of the widest stretch inside a polygon along its line, the first of equals.

    Between the first and second crossing, the third and fourth and so on a line is inside.
    """
    along = Window.partitionBy("code").orderBy("at")
    paired = crossed.select("code", F.col("at").alias("begin"), F.lead("at").over(along).alias("end"), F.row_number().over(along).alias("k")).where("k % 2 = 1 and end is not null")
    best = paired.groupBy("code").agg(F.max_by(F.struct("begin", "end"), F.struct(F.col("end") - F.col("begin"), -F.col("k"))).alias("b"))
    return best.select("code", ((F.col("b.begin") + F.col("b.end")) / 2).alias("middle"), (F.col("b.end") - F.col("b.begin")).alias("width"))


def polygon_points(vertices: DataFrame) -> DataFrame:
    """code, x, y and how, a row for each polygon.

    The centroid by area, if it lies inside (even-odd rule); else the middle of the widest stretch inside at
    the centroid's height; where that line has none, at half the height of the largest ring (the
    smallest ring number of equals).  Without any area it is the mean of all vertices.  Vertices
    without a coordinate are left out; a polygon that has none at all comes back with NULLs.
    """
    sides = edges(vertices)
    rings = ring_moments(sides)
    largest = F.max_by(F.struct("low", "high"), F.struct(F.abs("area"), -F.col("ring"))).alias("b")
    whole = rings.groupBy("code").agg(F.sum("area").alias("area"), F.sum("mx").alias("mx"), F.sum("my").alias("my"), largest)
    centre = whole.where("area <> 0").select("code", (F.col("mx") / F.col("area")).alias("cx"), (F.col("my") / F.col("area")).alias("cy"), ((F.col("b.low") + F.col("b.high")) / 2).alias("half"))
    at_centre = crossings(sides, centre.select("code", F.col("cy").alias("line")))
    right = at_centre.join(centre.select("code", "cx"), "code").groupBy("code").agg((F.count_if(F.col("at") > F.col("cx")) % 2 == 1).alias("within"))
    at_half = widest(crossings(sides, centre.select("code", F.col("half").alias("line"))))
    means = vertices.where("x is not null and y is not null").groupBy("code").agg(F.avg("x").alias("vx"), F.avg("y").alias("vy"))
    found = vertices.select("code").distinct().join(means, "code", "left").join(centre, "code", "left").join(right, "code", "left")
    found = found.join(widest(at_centre).where("width > 0").selectExpr("code", "middle as line_x"), "code", "left").join(at_half.selectExpr("code", "middle as half_x"), "code", "left")
    none, within = F.col("cx").isNull(), F.coalesce("within", F.lit(False))
    pick = lambda mean, centroid, line, half, failed: (
        F.when(none, mean).when(within, centroid).when(F.col("line_x").isNotNull(), line).when(F.col("half_x").isNotNull(), half).otherwise(failed)
    )
    return found.select(
        "code",
        pick(F.col("vx"), F.col("cx"), F.col("line_x"), F.col("half_x"), F.col("cx")).alias("x"),
        pick(F.col("vy"), F.col("cy"), F.col("cy"), F.col("half"), F.col("cy")).alias("y"),
        pick(F.lit(MEAN), F.lit(CENTROID), F.lit(INSIDE), F.lit(INSIDE), F.lit(FAILED)).alias("how"),
    )


def _boxes(sides: DataFrame, side: float, name: str) -> DataFrame:
    """Bounding boxes with the grid cells that they reach, a row for each cell."""
    box = sides.groupBy(F.col("code").alias(name)).agg(*[f(c).alias(f"{name}_{c}{k}") for c in ("x", "y") for f, k in ((F.min, 0), (F.max, 1))])
    for c in ("x", "y"):
        box = box.withColumn(f"__{c}", F.explode(F.sequence(F.floor(F.col(f"{name}_{c}0") / side), F.floor(F.col(f"{name}_{c}1") / side))))
    return box


def _in_strips(sides: DataFrame, side: float, name: str) -> DataFrame:
    """Edges cut at the borders of vertical strips: their direction, ends a < b and heights there; vertical ones bound no area."""
    low, high = F.least("x", "x1"), F.greatest("x", "x1")
    cut = sides.where("x <> x1").withColumn("strip", F.explode(F.sequence(F.floor(low / side), F.floor(high / side))))
    cut = cut.withColumns({"a": F.greatest(low, F.col("strip") * F.lit(side)), "b": F.least(high, (F.col("strip") + 1) * F.lit(side))}).where("a < b")
    height = lambda at: F.col("y") + (F.col(at) - F.col("x")) * (F.col("y1") - F.col("y")) / (F.col("x1") - F.col("x"))
    return cut.select(F.col("code").alias(name), "strip", *[e.alias(f"{name}_{k}") for k, e in {"s": F.signum(F.col("x1") - F.col("x")), "a": F.col("a"), "b": F.col("b"), "ya": height("a"), "yb": height("b")}.items()])


def overlaps(left: DataFrame, right: DataFrame, side: float) -> DataFrame:
    """code, other and the area that the two polygons share, for pairs that share any.

    Polygons whose boxes meet in a cell of a grid are candidates; their edges meet strip by strip.  The
    area under both of two edges, with the sign of their directions, summed over all pairs of edges
    is the area shared, whatever the shapes; rings must not cross themselves, holes run the other way.
    side: width of cells and strips, near a polygon's usual width.
    """
    one, two = edges(left), edges(right)
    met = _boxes(one, side, "p").join(_boxes(two, side, "q"), ["__x", "__y"])
    corner = F.expr(f"__x = floor(greatest(p_x0, q_x0) / {side}D) and __y = floor(greatest(p_y0, q_y0) / {side}D)")  # of the cells that both reach one
    met = met.where("p_x0 < q_x1 and q_x0 < p_x1 and p_y0 < q_y1 and q_y0 < p_y1").where(corner).select("p", "q", F.col("p_y0").alias("floor"))
    pairs = met.join(_in_strips(one, side, "p"), "p").join(_in_strips(two, side, "q"), ["q", "strip"])
    pairs = pairs.withColumns({"a": F.greatest("p_a", "q_a"), "b": F.least("p_b", "q_b")}).where("a < b")
    at = lambda k, x: F.col(f"{k}_ya") + (F.col(x) - F.col(f"{k}_a")) * (F.col(f"{k}_yb") - F.col(f"{k}_ya")) / (F.col(f"{k}_b") - F.col(f"{k}_a"))
    pairs = pairs.select("p", "q", "floor", (F.col("p_s") * F.col("q_s")).alias("s"), (F.col("b") - F.col("a")).alias("w"), at("q", "a").alias("qa"), at("q", "b").alias("qb"), (at("p", "a") - at("q", "a")).alias("da"), (at("p", "b") - at("q", "b")).alias("db"))
    # The mean height of the lower edge: the other's, less what this one lies below it.
    below = F.when((F.col("da") <= 0) & (F.col("db") <= 0), (F.col("da") + F.col("db")) / 2).when((F.col("da") >= 0) & (F.col("db") >= 0), 0.0)
    crossed = -F.pow(F.least("da", "db"), F.lit(2)) / (2 * (F.abs("da") + F.abs("db")))
    area = F.abs(F.sum(F.col("s") * F.col("w") * ((F.col("qa") + F.col("qb")) / 2 - F.col("floor") + below.otherwise(crossed))))
    return pairs.groupBy(F.col("p").alias("code"), F.col("q").alias("other")).agg(area.alias("area")).where("area > 0")


def cell_areas(sides: DataFrame, side: float) -> DataFrame:
    """p, strip, cy and the area that each polygon has in each cell of a grid that it reaches: of its edges, what lies below them in the cell."""
    lowest = sides.groupBy(F.col("code").alias("p")).agg(F.min("y").alias("lowest"))
    cut = _in_strips(sides, side, "p").join(lowest, "p")
    cut = cut.withColumn("cy", F.explode(F.sequence(F.floor(F.col("lowest") / side), F.floor(F.greatest("p_ya", "p_yb") / side))))
    cut = cut.withColumns({f"h{k}": F.col(f"p_y{k}") - F.col("cy") * F.lit(side) for k in "ab"})
    within = lambda h: F.least(F.greatest(h, F.lit(0.0)), F.lit(side))
    upto = lambda c: F.pow(within(F.col(c)), F.lit(2)) / 2 + side * F.greatest(F.col(c) - side, F.lit(0.0))
    rise, same = F.col("hb") - F.col("ha"), within(F.col("ha")) == within(F.col("hb"))
    flat = same | (F.abs(F.col("hb") - F.col("ha")) < side * 1e-9)
    mean = F.when(flat, within((F.col("ha") + F.col("hb")) / 2)).otherwise((upto("hb") - upto("ha")) / F.nullif(rise, F.lit(0.0)))
    return cut.groupBy("p", "strip", "cy").agg(F.abs(F.sum(F.col("p_s") * (F.col("p_b") - F.col("p_a")) * mean)).alias("area"))


def _crowded(left: DataFrame, right: DataFrame, side: float, least: float) -> DataFrame:
    """code of polygons on which so much lies that not even all of their own area is a share of ``least``.

    What lies on a polygon is at least, cell by cell: all that the others have there, where it fills the cell, and
    else its own area there for each of the others that fill the cell.  Nothing of a size of pairs is formed.
    """
    whole = side * side
    fills, slack = F.col("area") >= whole * (1 - 1e-9), whole * 1e-6
    cover = cell_areas(edges(right), side).groupBy("strip", "cy").agg(F.sum("area").alias("all"), F.count("*").alias("n"), F.count_if(fills).alias("n_full"))
    lies = F.when(fills, F.col("all") - F.col("n") * slack).otherwise((F.col("area") - slack) * F.col("n_full"))
    sums = cell_areas(edges(left), side).join(cover, ["strip", "cy"], "left").groupBy("p").agg(F.sum("area").alias("own"), F.sum(F.greatest(lies, F.lit(0.0))).alias("lies"))
    return sums.where(F.col("own") * (1 + 1e-6) < F.col("lies") * least).select(F.col("p").alias("code"))


def overlay_weights(left: DataFrame, right: DataFrame, side: float, least: float = 0.01, digits: int = 4) -> DataFrame:
    """code, other and weight: shares of each polygon's overlaps, those under ``least`` left out and the rest scaled to 1.

    Polygons that can have no share of ``least`` are told before by sums over cells; others have pairs by the
    area that lies on them, at most about 1 / least of their own.
    """
    whole = Window.partitionBy("code")
    rest = left.join(_crowded(left, right, side / 4, least), "code", "left_anti") if least > 0 else left
    share = overlaps(rest, right, side).withColumn("share", F.col("area") / F.sum("area").over(whole)).where(F.col("share") >= least)
    return share.select("code", "other", F.round(F.col("share") / F.sum("share").over(whole), digits).alias("weight"))
