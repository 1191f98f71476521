"""One query per operator; importing this package registers them."""

import importlib

from pixelfold.queries.base import ORACLES, QUERIES

for _module in ("selection", "rasters", "series", "analysis", "streams", "plans"):
    importlib.import_module(f"pixelfold.queries.{_module}")

__all__ = ["ORACLES", "QUERIES"]
