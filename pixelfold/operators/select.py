"""Selection of observations, scenes and collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelfold.functions import dates
from pixelfold.operators import area
from pixelfold.operators.skew import attach

# Polygons up to this size are tested by one expression.
FEW_CORNERS = 64
DEFAULT_TILE_RANGE = (-999, 9999)


def parse_temporal(df: DataFrame, col: str) -> DataFrame:
    """Add ``kind`` (date-time, date, year, time, open, invalid), ``instant`` and ``day_second``."""
    return df.withColumns({
        "kind": dates.temporal_kind(col),
        "instant": dates.temporal_instant(col),
        "day_second": dates.temporal_seconds(col),
    })


def filter_temporal(df: DataFrame, start, end, col="date") -> DataFrame:
    """Rows in [start, end); a ``None`` end is open."""
    if start is not None:
        df = df.where(F.col(col) >= F.lit(start).cast(df.schema[col].dataType))
    if end is not None:
        df = df.where(F.col(col) < F.lit(end).cast(df.schema[col].dataType))
    return df


def filter_date_range(df: DataFrame, first, last, col="date") -> DataFrame:
    """Rows between two dates, both included."""
    kind = df.schema[col].dataType
    if kind.simpleString() == "date":
        return df.where(F.col(col).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    day_after = F.date_add(F.lit(last).cast("date"), 1).cast(kind)
    return df.where((F.col(col) >= F.lit(first).cast(kind)) & (F.col(col) < day_after))


def filter_doy_range(df: DataFrame, low=1, high=366, col="date") -> DataFrame:
    return df.where(dates.in_doy_range(F.col(col), low, high))


def filter_bbox(scenes: DataFrame, west, south, east, north) -> DataFrame:
    """Items whose box overlaps the given box; touching edges count."""
    return scenes.where(
        (F.col("west") <= east) & (F.col("east") >= west)
        & (F.col("south") <= north) & (F.col("north") >= south)
    )


def point_in_ring(lon: Column, lat: Column, *rings) -> Column:
    """Ray-crossing parity against all edges of closed rings of (lon, lat) corners; a ring inside another is a hole."""
    crossings = []
    for ring in rings:
        corners = [(float(a), float(b)) for a, b, *_ in ring]
        if corners[0] != corners[-1]:
            corners.append(corners[0])
        for (x1, y1), (x2, y2) in zip(corners, corners[1:]):
            if y1 == y2:
                continue
            spans = (lat >= min(y1, y2)) & (lat < max(y1, y2))
            edge_lon = F.lit(x2 - x1) * (lat - y1) / F.lit(y2 - y1) + F.lit(x1)
            crossings.append(F.when(spans & (lon < edge_lon), 1).otherwise(0))
    total = reduce(lambda a, b: a + b, crossings, F.lit(0))
    return total % 2 == 1


def filter_aoi(df: DataFrame, *rings, lon="lon", lat="lat") -> DataFrame:
    """Rows whose point lies inside a polygon, given by its ring or rings.

    The bounding box is a plain range predicate, so it reaches the scan.  Small
    polygons are one expression; larger ones are looked up by cell
    (``area.filter_area``), with the same result.
    """
    if sum(len(ring) for ring in rings) > FEW_CORNERS:
        return area.filter_area(df, area.ring_edges(df.sparkSession, rings), lon, lat)
    xs = [float(p[0]) for ring in rings for p in ring]
    ys = [float(p[1]) for ring in rings for p in ring]
    boxed = df.where(F.col(lon).between(min(xs), max(xs)) & F.col(lat).between(min(ys), max(ys)))
    return boxed.where(point_in_ring(F.col(lon), F.col(lat), *rings))


def filter_tile_range(df: DataFrame, x_range=DEFAULT_TILE_RANGE, y_range=DEFAULT_TILE_RANGE) -> DataFrame:
    return df.where(F.col("tile_x").between(*x_range) & F.col("tile_y").between(*y_range))


def filter_tile_allowlist(df: DataFrame, tiles: DataFrame | None,
                          x_range=DEFAULT_TILE_RANGE, y_range=DEFAULT_TILE_RANGE) -> DataFrame:
    """Tiles inside the square extent and, if given, in the allow-list.

    ``tiles`` has columns ``tile_x, tile_y``; on a table partitioned by tile the
    semi join prunes partitions at run time.
    """
    inside = filter_tile_range(df, x_range, y_range)
    if tiles is None:
        return inside
    wanted = filter_tile_range(tiles, x_range, y_range).select("tile_x", "tile_y").distinct()
    return inside.join(wanted, ["tile_x", "tile_y"], "left_semi")


def filter_sensors(df: DataFrame, sensors, definitions: DataFrame) -> DataFrame:
    """Rows of the chosen sensors, limited to the bands that all of them have.

    ``df`` is long (``sensor, band, ...``); ``definitions`` lists the bands of
    every sensor as ``sensor, band``.  There are few bands and each holds many
    rows, so the join spreads a band over tasks.
    """
    sensors = sorted(set(sensors))
    shared = (
        definitions.where(F.col("sensor").isin(sensors))
        .select("sensor", "band").distinct()
        .groupBy("band").agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == len(sensors))
        .select("band")
    )
    spread = [c for c in df.columns if c not in ("sensor", "band")]
    # one row per band: the join filters and multiplies nothing
    return attach(df.where(F.col("sensor").isin(sensors)), shared, ["band"], spread, "inner").select(*df.columns)


def target_sensor(frames, name: str, bands) -> DataFrame:
    """Union of inputs relabelled as one sensor that carries ``bands``."""
    parts = []
    for frame in frames:
        others = [c for c in frame.columns if c != "sensor" and (c in bands or not _is_band(c))]
        parts.append(frame.select(*others, F.lit(name).alias("sensor")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _is_band(column: str) -> bool:
    return column[:1] == "B" and column[1:2].isdigit()


ACQUISITION = ("pixel_id", "date", "sensor")


def join_quality(df: DataFrame, main="BOA", quality: str | None = "QAI", key=ACQUISITION) -> DataFrame:
    """Main product rows with the flags of the quality product of the same acquisition.

    Quality rows of one acquisition are folded to one word first, so the join
    never multiplies rows.  Both sides grow with the data, hence a merge join
    rather than a broadcast chosen from compressed file sizes.  Without a quality product, or without its row, the
    flags are NULL and only nodata can be screened.
    """
    product = df.where(F.col("product") == main).drop("product", "qai")
    if quality is None:
        return product.withColumn("qai", F.lit(None).cast("int"))
    flags = (
        df.where((F.col("product") == quality) & F.col("qai").isNotNull())
        .groupBy(*key).agg(F.bit_or("qai").alias("qai"))
    )
    return product.join(flags.hint("merge"), list(key), "left")


def prefer_improphe(original: DataFrame, enhanced: DataFrame, use: bool,
                    key=ACQUISITION, value="value") -> DataFrame:
    """Enhanced values where they exist and the switch is on, else the original.

    ``value`` is one column or a list.  Copies of an enhanced acquisition are
    folded to their maximum first, so the join never multiplies rows.
    """
    if not use:
        return original.withColumn("enhanced", F.lit(False))
    values = [value] if isinstance(value, str) else list(value)
    better = enhanced.groupBy(*key).agg(F.lit(True).alias("_found"), *[F.max(v).alias(f"_{v}") for v in values])
    joined = original.join(better.hint("merge"), list(key), "left")
    return (
        joined.withColumns({v: F.coalesce(f"_{v}", v) for v in values})
        .withColumn("enhanced", F.col("_found").isNotNull())
        .drop("_found", *[f"_{v}" for v in values])
    )


def _property(name: str, columns) -> Column:
    if name in columns:
        return F.col(name)
    if "properties" in columns:
        if columns["properties"] == "string":
            return F.get_json_object("properties", f"$.{name}")
        return F.col("properties")[name]
    raise ValueError(f"no property {name}")


def filter_properties(scenes: DataFrame, predicates: dict) -> DataFrame:
    """Keep items whose properties satisfy every predicate.

    A predicate is a value, a list of values, or a (low, high) tuple; either
    end of the tuple may be ``None``.  Properties are columns, or entries of
    ``properties`` (a map or JSON text).
    """
    for name, wanted in predicates.items():
        prop = _property(name, dict(scenes.dtypes))
        if isinstance(wanted, tuple):
            low, high = wanted
            number = prop if name in scenes.columns else prop.try_cast("double")
            if low is not None:
                scenes = scenes.where(number >= low)
            if high is not None:
                scenes = scenes.where(number <= high)
        elif isinstance(wanted, list):
            scenes = scenes.where(prop.isin(wanted))
        else:
            scenes = scenes.where(prop == wanted)
    return scenes


def scatter_dates(items: DataFrame, request_dates) -> DataFrame:
    """One unit of work per item and request date.

    The dates are a parameter of the caller, so each item row simply expands
    to them where it lies; nothing is joined or shuffled.
    """
    wanted = F.array(*[F.lit(d).cast("date") for d in request_dates])
    return items.withColumn("request_date", F.explode(wanted))


def merge_collections(*parts: DataFrame, key="item_id") -> DataFrame:
    """Gather sub-collections; a repeated item is kept once.

    The copy from the earliest part wins, then the one with the smallest columns
    in their order (maps by their JSON text, NULL first).  The aggregate combines
    copies before the shuffle, however many there are.
    """
    columns = [c for c in parts[0].columns if c != key]
    ranked = [p.select(key, F.lit(i).alias("_part"), *columns) for i, p in enumerate(parts)]
    together = reduce(lambda a, b: a.unionByName(b), ranked)
    row = F.struct(*columns)
    place = [F.to_json(c).alias(c) if "map<" in kind or kind == "variant" else F.col(c) for c, kind in together.dtypes if c in columns]
    best = together.groupBy(key).agg(F.min_by(row, F.struct("_part", *place)).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in columns])


def collection_extent(scenes: DataFrame, by=()) -> DataFrame:
    return scenes.groupBy(*by).agg(
        F.min("west").alias("west"), F.min("south").alias("south"),
        F.max("east").alias("east"), F.max("north").alias("north"),
        F.min("datetime").alias("start"), F.max("datetime").alias("end"),
        F.count(F.lit(1)).alias("items"),
    )


def list_assets(items: DataFrame, key="item_id") -> DataFrame:
    """Flat list of the files of every item."""
    return items.select(key, F.explode("assets").alias("name", "href"))


def list_folder(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, name, length, modified) of the files directly in a folder; contents are not read."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length",
                                    F.col("modificationTime").alias("modified"))


ROOT_NAMES = ("collection.json", "catalog.json")


def pick_root(results: DataFrame, default="collection.json") -> DataFrame:
    """Root document of every result set.

    Order of choice: the requested name, the usual root names, then the
    shortest path.  Only JSON documents can be roots; ``fallback`` marks a set
    without one, which gets the requested name.
    """
    names = [default, *[n for n in ROOT_NAMES if n != default]]
    leaf = F.element_at(F.split("path", "/"), -1)
    rank = F.lit(len(names))
    for i, n in reversed(list(enumerate(names))):
        rank = F.when(leaf == n, i).otherwise(rank)
    candidate = F.when(F.col("path").endswith(".json"), F.struct(rank.alias("rank"), F.length("path").alias("size"), "path"))
    return results.groupBy("result_set").agg(F.min(candidate).alias("_c")).select(
        "result_set",
        F.coalesce(F.col("_c.path"), F.lit(default)).alias("root"),
        F.col("_c").isNull().alias("fallback"),
    )


def check_nonempty(df: DataFrame, fail=False) -> DataFrame:
    """One row with the row count and ``ok`` / ``warning``; ``fail`` raises instead."""
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
    if fail:
        guarded = F.when(F.col("n_rows") == 0, F.raise_error(F.lit("no rows were read")).cast("bigint")).otherwise(F.col("n_rows"))
        counted = counted.select(guarded.alias("n_rows"))
    return counted.withColumn("status", F.when(F.col("n_rows") > 0, "ok").otherwise("warning"))
