"""Box algebra on columns x1, y1, x2, y2 (half-open, x1 < x2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def intersection(a: Box, b: Box) -> Column:
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where both are empty."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def share_inside(inner: Box, outer: Box) -> Column:
    """The part of `inner` that lies in `outer`."""
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(0.0)


def centre_inside(inner: Box, outer: Box) -> Column:
    x, y = (inner[0] + inner[2]) / 2, (inner[1] + inner[3]) / 2
    return (x >= outer[0]) & (x < outer[2]) & (y >= outer[1]) & (y < outer[3])


def rotated_back(x: Column, y: Column, turn: Column, width: Column, height: Column) -> list[Column]:
    """A point of a frame turned counter-clockwise by 0, 90, 180 or 270 degrees, back in the frame of width and height."""
    return [
        F.when(turn == 0, x).when(turn == 90, width - y).when(turn == 180, width - x).otherwise(y),
        F.when(turn == 0, y).when(turn == 90, x).when(turn == 180, height - y).otherwise(height - x),
    ]


def checked(b: Box, width: Column, height: Column) -> list[Column]:
    """The smallest box of whole numbers that holds b, within the frame; null where b is empty, reversed, null or wholly outside."""
    x1, y1 = F.greatest(F.floor(b[0]), F.lit(0)), F.greatest(F.floor(b[1]), F.lit(0))
    x2, y2 = F.least(F.ceil(b[2]), width), F.least(F.ceil(b[3]), height)
    ok = (b[0] < b[2]) & (b[1] < b[3]) & (x1 < x2) & (y1 < y2)
    return [F.when(ok, x.cast("double")) for x in (x1, y1, x2, y2)]


def letterboxed(b: Box, width: Column, height: Column, side: float) -> list[Column]:
    """b in a square of `side` into which its frame is scaled and centred."""
    scale = side / F.greatest(width, height)
    dx, dy = (side - width * scale) / 2, (side - height * scale) / 2
    return [b[0] * scale + dx, b[1] * scale + dy, b[2] * scale + dx, b[3] * scale + dy]


def unletterboxed(b: Box, width: Column, height: Column, side: float) -> list[Column]:
    """The inverse of letterboxed."""
    scale = side / F.greatest(width, height)
    dx, dy = (side - width * scale) / 2, (side - height * scale) / 2
    return [(b[0] - dx) / scale, (b[1] - dy) / scale, (b[2] - dx) / scale, (b[3] - dy) / scale]


def moved(b: Box, x: Column, y: Column) -> list[Column]:
    return [b[0] + x, b[1] + y, b[2] + x, b[3] + y]


def flipped(b: Box, height: Column) -> list[Column]:
    """From an origin at the bottom left to one at the top left."""
    return [b[0], height - b[3], b[2], height - b[1]]


def area_share(b: Box, width: Column, height: Column) -> Column:
    """The part of the frame that b takes; null without a frame."""
    return F.when((width > 0) & (height > 0), area(b) / (width * height))
