"""Points in polygons of any number of corners, by an index of the plane's cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelfold.operators.skew import attach

# Cells along a side: about two for every edge on the way across, within these bounds.
LEAST_CELLS, MOST_CELLS = 16, 1024


def ring_edges(spark: SparkSession, rings) -> DataFrame:
    """(x1, y1, x2, y2) of closed rings of (lon, lat) corners."""
    edges = []
    for ring in rings:
        corners = [(float(a), float(b)) for a, b, *_ in ring]
        edges += [(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True) if a != b]
    return spark.createDataFrame(edges, "x1 double, y1 double, x2 double, y2 double")


def corner_edges(corners: DataFrame, keys=(), ring="ring", order="seq", lon="lon", lat="lat") -> DataFrame:
    """(keys, x1, y1, x2, y2) of rings given as a table of ordered corners; the last corner is joined to the first."""
    along = Window.partitionBy(*keys, ring).orderBy(order)
    first = [F.first(c).over(along) for c in (lon, lat)]
    linked = corners.select(*keys, F.col(lon).cast("double").alias("x1"), F.col(lat).cast("double").alias("y1"),
                            *[F.coalesce(F.lead(c).over(along), f).cast("double").alias(n) for c, f, n in zip((lon, lat), first, ("x2", "y2"), strict=True)])
    return linked.where("x1 != x2 or y1 != y2")


class CellIndex:
    """Cells of the plane with what decides whether a point in them is inside.

    A cell without edges lies inside or outside as a whole.  In the others a
    point is compared with the cell's lower left corner, whose side is known:
    along the cell's left border up to the height of the point, then straight to
    the point; every edge that is crossed changes sides.  Only edges that touch
    the cell can be crossed.  Rings in rings are holes; of a point on an edge
    the side is not defined.  ``keys`` tell areas apart; all share the cells.
    """

    def __init__(self, edges: DataFrame, keys=(), cells: int | None = None):
        self.keys = list(keys)
        found = edges.agg(F.min(F.least("x1", "x2")).alias("w"), F.min(F.least("y1", "y2")).alias("s"), F.max(F.greatest("x1", "x2")).alias("e"),
                          F.max(F.greatest("y1", "y2")).alias("n"), F.count(F.lit(1)).alias("edges")).first()
        self.empty = not found["edges"]
        self.n = cells or min(MOST_CELLS, max(LEAST_CELLS, 2 * math.isqrt(found["edges"])))
        self.box = (0.0, 0.0, 1.0, 1.0) if self.empty else tuple(found[c] for c in "wsen")
        w, s, e, n = self.box
        # borders between cells keep clear of corners, which often are round numbers
        self.dx, self.dy = ((b - a or 1.0) * (1 + 0.0271828) / self.n for a, b in ((w, e), (s, n)))
        self.west, self.south = w - self.dx * 0.31415926535, s - self.dy * 0.31415926535
        self.n += 1
        self.cells = self._cells(edges)

    def column(self, x: Column) -> Column:
        return F.floor((x - self.west) / F.lit(self.dx)).cast("int")

    def row(self, y: Column) -> Column:
        return F.floor((y - self.south) / F.lit(self.dy)).cast("int")

    def _touching(self, edges: DataFrame) -> DataFrame:
        """Every edge in every cell it passes, by rows and then by the columns passed within the row."""
        ends = edges.withColumns({"_lo": F.least("y1", "y2"), "_hi": F.greatest("y1", "y2")})
        rows = ends.withColumn("_cy", F.explode(F.sequence(self.row(F.col("_lo")), self.row(F.col("_hi")))))
        bottom = F.greatest(F.col("_lo"), F.lit(self.south) + F.col("_cy") * self.dy)
        top = F.least(F.col("_hi"), F.lit(self.south) + (F.col("_cy") + 1) * self.dy)
        at = lambda y: F.when(F.col("y1") == F.col("y2"), None).otherwise(crossing_x("x1", "y1", "x2", "y2", y))
        spans = [F.coalesce(at(bottom), F.col("x1")), F.coalesce(at(top), F.col("x2"))]
        within = lambda v: F.greatest(F.least(F.col("x1"), F.col("x2")), F.least(F.greatest(F.col("x1"), F.col("x2")), v))
        left, right = (within(f(*spans)) for f in (F.least, F.greatest))
        slack = F.lit(self.dx * 1e-9)
        return rows.withColumn("_cx", F.explode(F.sequence(self.column(left - slack), self.column(right + slack))))

    def _corners(self, edges: DataFrame) -> DataFrame:
        """Whether the lower left corner of every cell lies inside: crossings left of it, summed up along its row."""
        lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
        # rows whose lower border the edge crosses
        first, last = self.row(lo) + 1, self.row(hi)
        crossed = edges.withColumns({"_a": first, "_b": last}).where("_a <= _b").withColumn("_cy", F.explode(F.sequence("_a", "_b")))
        border = F.lit(self.south) + F.col("_cy") * self.dy
        column = F.ceil((crossing_x("x1", "y1", "x2", "y2", border) - self.west) / self.dx).cast("int")
        steps = crossed.groupBy(*self.keys, "_cy", column.alias("_cx")).agg(F.count(F.lit(1)).alias("_n"))
        # one row a crossed border: its columns up to the right end
        filled = steps.groupBy(*self.keys, "_cy").agg(F.map_from_entries(F.collect_list(F.struct("_cx", "_n"))).alias("_m"))
        filled = filled.select(*self.keys, "_cy", "_m", F.explode(F.sequence(F.lit(0), F.lit(self.n - 1))).alias("_cx"))
        along = Window.partitionBy(*self.keys, "_cy").orderBy("_cx").rowsBetween(Window.unboundedPreceding, 0)
        passed = F.sum(F.coalesce(F.try_element_at("_m", F.col("_cx")), F.lit(0))).over(along)
        return filled.select(*self.keys, "_cx", "_cy", (passed % 2 == 1).alias("_corner"))

    def _cells(self, edges: DataFrame) -> DataFrame:
        at = [*self.keys, "_cx", "_cy"]
        edge = F.struct("x1", "y1", "x2", "y2")
        near = self._touching(edges).groupBy(*at).agg(F.collect_list(edge).alias("_edges"))
        both = near.join(self._corners(edges), at, "full")
        none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
        return both.select(*at, F.coalesce("_corner", F.lit(False)).alias("_corner"), F.coalesce("_edges", none).alias("_edges")).where(
            F.col("_corner") | (F.size("_edges") > 0))

    def inside(self, lon: Column, lat: Column, corner: Column, edges: Column) -> Column:
        """Parity of the crossings between the cell's corner and the point; needs ``_cx, _cy`` of the point."""
        left, bottom = F.lit(self.west) + F.col("_cx") * self.dx, F.lit(self.south) + F.col("_cy") * self.dy

        def crossings(total: Column, e: Column) -> Column:
            x1, y1, x2, y2 = (e[c] for c in ("x1", "y1", "x2", "y2"))
            level = ((y1 <= lat) != (y2 <= lat)) & crossing_x(x1, y1, x2, y2, lat).between(left, lon)
            upright = ((x1 <= left) != (x2 <= left)) & crossing_x(y1, x1, y2, x2, left).between(bottom, lat)
            one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
            return total + one(level) + one(upright)

        return F.aggregate(edges, corner.cast("int"), crossings) % 2 == 1

    def located(self, df: DataFrame, lon="lon", lat="lat") -> DataFrame:
        """The rows of ``df`` in the box of all areas, with their cell."""
        w, s, e, n = self.box
        boxed = df.where(F.col(lon).between(w, e) & F.col(lat).between(s, n))
        return boxed.withColumns({"_cx": self.column(F.col(lon)), "_cy": self.row(F.col(lat))})


def crossing_x(x1, y1, x2, y2, y) -> Column:
    """Where an edge meets a level; NULL for level edges."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return (c(x2) - c(x1)) * (y - c(y1)) / F.nullif(c(y2) - c(y1), F.lit(0.0)) + c(x1)


def filter_area(df: DataFrame, edges: DataFrame, lon="lon", lat="lat", cells: int | None = None) -> DataFrame:
    """Rows whose point lies inside the area of ``edges`` (``ring_edges``, ``corner_edges``).

    One equi-join by cell; rows are not multiplied, and the plan does not grow
    with the number of corners.
    """
    index = CellIndex(edges, cells=cells)
    if index.empty:
        return df.where("false")
    joined = attach(index.located(df, lon, lat), index.cells, ["_cx", "_cy"], [lon, lat], "inner", salts=8)
    return joined.where(index.inside(F.col(lon), F.col(lat), F.col("_corner"), F.col("_edges"))).select(*df.columns)


def find_zone(df: DataFrame, edges: DataFrame, zone="zone", rank="rank", lon="lon", lat="lat", cells: int | None = None) -> DataFrame:
    """Add ``zone``: the area with the smallest ``rank`` that holds the point, NULL if none does.

    ``edges`` carry ``zone`` and ``rank``.
    """
    index = CellIndex(edges, [zone, rank], cells)
    held = F.struct(F.col(rank), F.col(zone), F.col("_corner"), F.col("_edges"))
    by_cell = index.cells.groupBy("_cx", "_cy").agg(F.array_sort(F.collect_list(held)).alias("_areas"))
    placed = df.withColumns({"_cx": index.column(F.col(lon)), "_cy": index.row(F.col(lat))})
    joined = attach(placed, by_cell, ["_cx", "_cy"], [lon, lat], salts=8)
    hit = F.filter("_areas", lambda a: index.inside(F.col(lon), F.col(lat), a["_corner"], a["_edges"]))
    return joined.withColumn(zone, F.get(hit, F.lit(0))[zone]).drop("_cx", "_cy", "_areas")
