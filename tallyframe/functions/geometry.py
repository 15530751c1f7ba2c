"""Column expressions over boxes, points and 3x3 transforms (nine doubles, row by row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def center(x1, y1, x2, y2) -> tuple[Column, Column]:
    return (x1 + x2) / 2, (y1 + y2) / 2


def area(x1, y1, x2, y2) -> Column:
    """Area with negative sides counted as none."""
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))


def project(h: list[Column], x: Column, y: Column, valid: Column | None = None) -> tuple[Column, Column]:
    """The point under the transform; null where that is invalid or the point goes to infinity."""
    w = h[6] * x + h[7] * y + h[8]
    fine = F.abs(w) >= 1e-8
    if valid is not None:
        fine = fine & valid
    return F.when(fine, (h[0] * x + h[1] * y + h[2]) / w), F.when(fine, (h[3] * x + h[4] * y + h[5]) / w)


def project_box(h: list[Column], box: Box, valid: Column | None = None) -> Box:
    """Axis-aligned hull of the projected corners; null if any corner is."""
    x1, y1, x2, y2 = box
    corners = [project(h, x, y, valid) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    whole = F.lit(True)
    for c in xs:
        whole = whole & c.isNotNull()
    return tuple(F.when(whole, f(*v)) for f, v in ((F.least, xs), (F.least, ys), (F.greatest, xs), (F.greatest, ys)))


def compose(outer: list[Column], inner: list[Column]) -> list[Column]:
    """Entries of the matrix product outer x inner."""
    return [sum((outer[3 * r + k] * inner[3 * k + c] for k in range(1, 3)), outer[3 * r] * inner[c]) for r in range(3) for c in range(3)]


def rescale(h: list[Column], source: float, target: float) -> list[Column]:
    """A transform between shrunken images, lifted to other scales of source and target."""
    factor = [source, source, 1.0]
    divisor = [target, target, 1.0]
    return [h[3 * r + c] * factor[c] / divisor[r] for r in range(3) for c in range(3)]


def iou(a: Box, b: Box) -> Column:
    """Overlap of two boxes whose corners are pixels, so that sides are one pixel longer."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + 1)
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + 1)
    size = lambda x: (x[2] - x[0] + 1) * (x[3] - x[1] + 1)
    return w * h / (size(a) + size(b) - w * h)


def clip(v: Column, top) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(top).cast("double") if not isinstance(top, Column) else top)


def to_corner_size(box: Box) -> Box:
    x1, y1, x2, y2 = box
    return x1, y1, x2 - x1, y2 - y1


def to_normalised(box: Box, width, height) -> Box:
    """Centre and size as shares of the image, the box clipped to it first."""
    x1, x2 = clip(box[0], width), clip(box[2], width)
    y1, y2 = clip(box[1], height), clip(box[3], height)
    return (x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height


def from_normalised(box: Box, width, height) -> Box:
    cx, cy, w, h = box
    return (cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height


def padded_rectangle(box: Box, width: int, height: int, ratio: float, rounded: bool = True) -> Box:
    """The box widened by a share of its shorter side and clipped; half-even rounding or truncation."""
    x1, y1, x2, y2 = box
    pad = F.least(x2 - x1, y2 - y1) * ratio
    whole = F.rint if rounded else (lambda v: v.cast("int").cast("double"))
    return clip(whole(x1 - pad), width), clip(whole(y1 - pad), height), clip(whole(x2 + pad), width), clip(whole(y2 + pad), height)


def crop_size(rectangle: Box, none: int = 1) -> tuple[Column, Column]:
    """Width and height of the crop of a whole-numbered rectangle; one without area gives an empty image of side ``none``."""
    x1, y1, x2, y2 = rectangle
    whole = (x2 > x1) & (y2 > y1)
    return tuple(F.when(whole, side).otherwise(none).cast("int") for side in (x2 - x1, y2 - y1))


def letterbox(width: Column, height: Column, side: int) -> tuple[Column, Column, Column]:
    """Scale and offsets that fit an image into a square."""
    scale = F.lit(float(side)) / F.greatest(width, height)
    return scale, F.floor((side - F.rint(width * scale)) / 2), F.floor((side - F.rint(height * scale)) / 2)


def circularity(surface: Column, outline: Column) -> Column:
    return F.when(outline > 0, 4 * F.lit(3.141592653589793) * surface / (outline * outline))
