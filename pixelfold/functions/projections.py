"""Continental grids: zone choice and spherical projections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6370997.0

# Zones (fixed values): code, projection centre (lat, lon), and the lon/lat box
# that assigns a point to the zone.  Boxes are tried in this order; a zone may
# have several, what no box holds (open ocean) belongs to none.
# Asia west of 60 E begins east of the Red Sea, in steps along its middle.
WEST_ASIA = (
    (32.0, 33.0, 60.0, 36.0), (34.5, 28.0, 60.0, 33.0), (35.6, 24.0, 60.0, 28.0), (38.0, 20.0, 60.0, 24.0),
    (40.0, 16.0, 60.0, 20.0), (42.6, 14.0, 60.0, 16.0), (43.2, 12.7, 60.0, 14.0),
)
GLANCE7 = (
    ("AN", -90.0, 0.0, (-180.0, -90.0, 180.0, -60.0)),
    ("EU", 55.0, 20.0, (-32.0, 36.0, 50.0, 90.0)),
    *[("AS", 45.0, 100.0, box) for box in WEST_ASIA],
    ("AF", 5.0, 20.0, (-32.0, -60.0, 60.0, 36.0)),
    ("NA", 50.0, -100.0, (-180.0, 13.0, -32.0, 90.0)),
    ("SA", -15.0, -60.0, (-120.0, -60.0, -32.0, 13.0)),
    ("AS", 45.0, 100.0, (50.0, 0.0, 180.0, 90.0)),
    ("OC", -15.0, 135.0, (110.0, -55.0, 180.0, 25.0)),
)
EQUI7 = (
    ("AN", -90.0, 0.0, (-180.0, -90.0, 180.0, -60.0)),
    ("EU", 53.0, 24.0, (-32.0, 36.0, 50.0, 90.0)),
    *[("AS", 47.0, 94.0, box) for box in WEST_ASIA],
    ("AF", 8.5, 21.5, (-32.0, -60.0, 60.0, 36.0)),
    ("NA", 52.0, -97.5, (-180.0, 13.0, -32.0, 90.0)),
    ("SA", -14.0, -60.5, (-120.0, -60.0, -32.0, 13.0)),
    ("AS", 47.0, 94.0, (50.0, 0.0, 180.0, 90.0)),
    ("OC", -19.5, 131.5, (110.0, -55.0, 180.0, 25.0)),
)
# Grid name -> zones, tile size in metres, projection.
GRIDS = {"GLANCE7": (GLANCE7, 150000, "equal_area"), "EQUI7": (EQUI7, 100000, "equidistant")}


def zone_number(lon: Column, lat: Column, zones) -> Column:
    """Position of the first zone whose box holds the point; NULL outside all."""
    chosen = F.lit(None).cast("int")
    for i, (_, _, _, (w, s, e, n)) in reversed(list(enumerate(zones))):
        inside = (lon >= w) & (lon < e) & (lat >= s) & (lat < n)
        chosen = F.when(inside, i).otherwise(chosen)
    return chosen


def project(lon: Column, lat: Column, lon0: Column, lat0: Column, kind: str) -> tuple[Column, Column]:
    """Azimuthal projection around (lon0, lat0): equal-area or equidistant."""
    phi, phi0 = F.radians(lat), F.radians(lat0)
    lam = F.radians(lon - lon0)
    cosine = F.sin(phi0) * F.sin(phi) + F.cos(phi0) * F.cos(phi) * F.cos(lam)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))
    if kind == "equal_area":
        scale = F.sqrt(2 / F.greatest(1 + cosine, F.lit(1e-12)))
    else:
        arc = F.acos(cosine)
        scale = F.when(F.sin(arc) < 1e-12, F.lit(1.0)).otherwise(arc / F.sin(arc))
    x = EARTH_RADIUS * scale * F.cos(phi) * F.sin(lam)
    y = EARTH_RADIUS * scale * (F.cos(phi0) * F.sin(phi) - F.sin(phi0) * F.cos(phi) * F.cos(lam))
    return x, y
