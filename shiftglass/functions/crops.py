"""Close-ups: windows around small people, how they are scaled, and boxes found in them in frame pixels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Margins in box widths and heights; height aimed at, largest enlargement and side; who is small.
PAD_X, PAD_TOP, PAD_BOTTOM = 0.30, 0.20, 0.08
TARGET_HEIGHT, MAX_ENLARGE, MAX_SIDE, SMALL = 640.0, 4.0, 1280.0, 360.0
KEEP_SIZE = 0.02


def wants_close_up(box: Column, below: float = SMALL) -> Column:
    """Whether a person is small enough in the frame."""
    height = box[3] - box[1]
    return (height > 0) & (height < below)


def window(box: Column, width, height) -> Column:
    """The padded box in whole pixels (x0, y0, x1, y1), held inside the frame; null if nothing sensible is left."""
    w, h = box[2] - box[0], box[3] - box[1]
    edge = F.array(
        F.greatest(F.lit(0.0), box[0] - PAD_X * w), F.greatest(F.lit(0.0), box[1] - PAD_TOP * h),
        F.least(F.lit(width).cast("double"), box[2] + PAD_X * w), F.least(F.lit(height).cast("double"), box[3] + PAD_BOTTOM * h),
    )
    fits = (w > 1) & (h > 1) & (edge[2] - edge[0] >= 2) & (edge[3] - edge[1] >= 2)
    return F.when(fits, F.transform(edge, lambda v: F.rint(v)))


def scaled(win: Column) -> Column:
    """(width, height) of a window's picture: enlarged to the height aimed at, within the limits, in whole pixels."""
    w, h = win[2] - win[0], win[3] - win[1]
    by = F.least(F.lit(MAX_ENLARGE), TARGET_HEIGHT / h, MAX_SIDE / F.greatest(w, h))
    size = lambda v: F.when(F.abs(by - 1) <= KEEP_SIZE, v).otherwise(F.greatest(F.lit(1.0), F.rint(v * by)))
    return F.when((w > 0) & (h > 0), F.struct(size(w).alias("width"), size(h).alias("height")))


def to_frame(box: Column, win: Column, picture: Column) -> Column:
    """A box found in a window's picture, in frame pixels."""
    sx, sy = picture["width"] / (win[2] - win[0]), picture["height"] / (win[3] - win[1])
    return F.array(win[0] + box[0] / sx, win[1] + box[1] / sy, win[0] + box[2] / sx, win[1] + box[3] / sy)


def to_picture(box: Column, win: Column, picture: Column) -> Column:
    """A box of the frame in pixels of a window's picture."""
    sx, sy = picture["width"] / (win[2] - win[0]), picture["height"] / (win[3] - win[1])
    return F.array((box[0] - win[0]) * sx, (box[1] - win[1]) * sy, (box[2] - win[0]) * sx, (box[3] - win[1]) * sy)
