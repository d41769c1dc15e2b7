"""Grid cells and unit conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlark.functions.conditions import limits, literal

# Cell edges and letters of the banded grid, conversion factors.
BAND_PREFIX = "33T"
BAND_COLUMNS = ((35.75, "W"), (36.25, "X"), (None, "Y"))
BAND_ROWS = ((44.25, "M"), (None, "N"))
KNOTS_TO_KPH = 1.852
FEET_TO_METRES = 0.3048


def _degrees(column: str, size: int = 1) -> str:
    scaled = column if size == 1 else f"{column} / {literal(float(size))}"
    return f"cast(cast({scaled} AS int) AS string)"


def grid_square(lat: str, lon: str, scheme: str) -> Column:
    """Name of the cell that holds a point, given the columns of its coordinates.

    ``band``: six lettered cells. ``degree``: truncated degrees written side by side;
    kept for compatibility, it is ambiguous ("12"+"3" = "1"+"23"). ``five_degree``:
    truncated five-degree cells. The degree schemes give NULL for a NULL coordinate.
    """
    if scheme == "band":
        parts = [literal(BAND_PREFIX), limits(lon, BAND_COLUMNS, "<"), limits(lat, BAND_ROWS, "<")]
    elif scheme == "degree":
        parts = [_degrees(lat), _degrees(lon)]
    elif scheme == "five_degree":
        parts = ["'GRID-'", _degrees(lat, 5), "'-'", _degrees(lon, 5)]
    else:
        raise ValueError(f"unknown grid scheme {scheme!r}")
    return F.expr(f"concat({', '.join(parts)})")


def knots_to_kph(col: Column) -> Column:
    return col * F.lit(KNOTS_TO_KPH)


def feet_to_metres(col: Column) -> Column:
    return col * F.lit(FEET_TO_METRES)


def geo_point(lat: str, lon: str) -> Column:
    """GeoJSON point; longitude comes first."""
    return F.expr(
        f"named_struct('type', 'Point', 'coordinates', array(coalesce({lon}, 0D), coalesce({lat}, 0D)))"
    )
