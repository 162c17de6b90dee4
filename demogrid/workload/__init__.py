"""Every operator bound to the driver's tables, with its reference SQL."""

from . import (access, air_weather, atlas, change, climate, layers, live, places, planning, raster, sources, spatial, streams, text, trees,  # noqa: F401
               warnings)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
