"""Posture from keypoints: a table of cues, each a feature, a band and a weight for sitting or standing.

Features have one value a leg, or one of both legs' midpoints, and none where a joint they rest
on is not seen, so a missing joint has no say. They are worked out over whole Arrow batches: as
one expression they were too large for compiled code and took 160 microseconds a person. Seen from the front a seated
thigh points at the camera: its drop below the hip, in torso lengths, weighs most, and bent
joints only speak where they show. Walking is standing that moves, on apart or unlike legs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

#: How sure a joint must be, and lengths in pixels below which a ratio says nothing.
SEEN, LEAST_TORSO_DY, LEAST_TORSO, LEAST_SHOULDERS = 0.15, 10.0, 8.0, 10.0
#: Feature, lowest and highest value (inclusive), side, weight. Open ends are None; "<" excludes the highest.
CUES = (
    ("knees", None, 138.0, "sits", 5.0), ("knees", 155.0, None, "stands", 1.0),
    ("hips", None, 128.0, "sits", 4.5), ("hips", 148.0, None, "stands", 0.8),
    ("mid_hip", None, 128.0, "sits", 4.0), ("mid_hip", 148.0, None, "stands", 0.8),
    ("thighs", None, "<0.80", "sits", 4.0),
    ("straight_span", 0.70, None, "stands", 3.0), ("span", None, "<0.55", "sits", 2.5),
    ("fold", None, 125.0, "sits", 6.0),
    ("drop", 0.55, None, "stands", 7.0), ("drop", None, 0.30, "sits", 8.0), ("vague_drop", None, None, "sits", 2.0),
    ("box", None, "<1.35", "sits", 1.5), ("box", 1.65, None, "stands", 1.5),
)
#: Pixels a frame, stride in shoulder widths (alone, or with knees this unlike), joints that are open enough.
WALK_SPEED, STRIDE, SHORT_STRIDE, UNLIKE_KNEES, OPEN_KNEE, OPEN_HIP = 4.5, 0.52, 0.35, 30.0, 142.0, 138.0
PAIRS = {"shoulder": 5, "hip": 11, "knee": 13, "ankle": 15}


#: Of both sides and the middle: limbs as vectors between two joints; bends where two limbs meet (the first turned round or not).
SIDES, LIMBS, BENDS = ("left", "right", "mid"), {"trunk": ("hip", "shoulder"), "thigh": ("hip", "knee"), "shin": ("knee", "ankle")}, {"knee": ("thigh", "shin", -1.0), "hip": ("trunk", "thigh", 1.0)}
PAIRED = ("knees", "hips", "thighs")
OTHER = {"stride": T.DoubleType(), "unlike": T.DoubleType(), "open": T.BooleanType(), "legless": T.BooleanType()}
FEATURES = T.StructType([T.StructField(n, OTHER.get(n, T.ArrayType(T.DoubleType()) if n in PAIRED else T.DoubleType())) for n in dict.fromkeys([*(c[0] for c in CUES), *OTHER])])

#: Values and where they are known; what is not known has no say.
Known = tuple[np.ndarray, np.ndarray]


# --------------------------------------------------------------------------- columns of a batch
def _read(a: pa.Array) -> Known:
    return pc.fill_null(a, 0.0).to_numpy(zero_copy_only=False), a.is_valid().to_numpy(zero_copy_only=False)


def _first(*values: Known) -> Known:
    v, ok = values[-1]
    for x, has in values[-2::-1]:
        v, ok = np.where(has, x, v), has | ok
    return v, ok


def _over(x: np.ndarray, low: float, equal: bool = True) -> np.ndarray:
    """As in SQL: what is no number is larger than any."""
    return ((x >= low) if equal else (x > low)) | np.isnan(x)


def _only(cond: np.ndarray, value: Known) -> Known:
    return value[0], value[1] & cond


def _measured(batch: tuple[pa.Array, ...]) -> dict[str, Known]:
    """Features by name (of paired ones ``_0`` and ``_1``), from the columns of ``_columns``."""
    n, raw = len(batch[0]), [_read(a) for a in batch]
    yes = np.ones(n, bool)
    p = {(name, s, c): raw.pop(0) for name in PAIRS for s in SIDES[:2] for c in "xy"}
    width, height = np.maximum(1.0, raw[0][0]), np.maximum(1.0, raw[1][0])
    for name in PAIRS:
        for c in "xy":
            (a, has_a), (b, has_b) = p[name, "left", c], p[name, "right", c]
            p[name, "mid", c] = _first(((a + b) / 2, has_a & has_b), (a, has_a), (b, has_b))
    seen = {(name, s): p[name, s, "x"][1] & p[name, s, "y"][1] for name in PAIRS for s in SIDES}
    limb = {(k, s): tuple(p[b, s, c][0] - p[a, s, c][0] for c in "xy") for k, (a, b) in LIMBS.items() for s in SIDES}
    has = {(k, s): seen[a, s] & seen[b, s] for k, (a, b) in LIMBS.items() for s in SIDES}
    length = {k: np.sqrt(x * x + y * y) for k, (x, y) in limb.items()}
    bend = {}
    for name, (a, b, sign) in BENDS.items():
        for s in SIDES:
            (ux, uy), (vx, vy), size = limb[a, s], limb[b, s], length[a, s] * length[b, s]
            cos = np.where(size == 0, 1.0, sign * (ux * vx + uy * vy) / np.where(size == 0, 1.0, size))  # 0 degrees where two joints are one
            bend[name, s] = np.degrees(np.arccos(np.maximum(-1.0, np.fmin(1.0, cos)))), has[a, s] & has[b, s]
    left, right = bend["knee", "left"], bend["knee", "right"]
    some_knee, some_hip = left[1] | right[1], bend["hip", "left"][1] | bend["hip", "right"][1]
    straight = some_knee & (~left[1] | _over(left[0], 155.0)) & (~right[1] | _over(right[0], 155.0))
    span = np.abs(p["ankle", "mid", "y"][0] - p["shoulder", "mid", "y"][0]) / height, seen["ankle", "mid"] & seen["shoulder", "mid"]
    tall = straight & span[1] & _over(span[0], 0.70)

    def share(a: np.ndarray, of: np.ndarray, least: float, ok: np.ndarray) -> Known:
        fits = ok & _over(of, least, False)
        return a / np.where(fits, of, 1.0), fits

    drop = share(limb["thigh", "mid"][1], length["trunk", "mid"], LEAST_TORSO, has["trunk", "mid"] & has["thigh", "mid"])
    thighs = [share(np.abs(limb["thigh", s][1]), np.abs(limb["trunk", s][1]), LEAST_TORSO_DY, has["trunk", s] & has["thigh", s]) for s in SIDES[:2]]
    (hl, has_hl), (hr, has_hr) = bend["hip", "left"], bend["hip", "right"]
    blind = ~seen["hip", "mid"] & ~(seen["knee", "mid"] & seen["ankle", "mid"])
    apart = lambda name, c: (p[name, "left", c][0] - p[name, "right", c][0], seen[name, "left"] & seen[name, "right"])
    (sx, two), (sy, _) = apart("shoulder", "x"), apart("shoulder", "y")
    stride = _first(apart("ankle", "x"), apart("knee", "x"), (np.zeros(n), yes))[0]
    return {
        "knees_0": _first(left, _only(~some_knee, bend["knee", "mid"])), "knees_1": right, "hips_0": bend["hip", "left"], "hips_1": bend["hip", "right"], "mid_hip": _only(~some_hip, bend["hip", "mid"]),
        "thighs_0": thighs[0], "thighs_1": thighs[1], "straight_span": _only(straight, span), "span": _only(~tall, span), "fold": _first((np.maximum(hl, hr), has_hl & has_hr), (hl, has_hl), (hr, has_hr), bend["hip", "mid"]),
        "drop": drop, "vague_drop": _only(_over(drop[0], 0.30, False) & (drop[0] < 0.55), drop), "box": (height / width, blind),
        "stride": (np.abs(stride) / np.maximum(LEAST_SHOULDERS, np.where(two, np.hypot(sx, sy), width * 0.4)), yes), "unlike": (np.where(left[1] & right[1], np.abs(left[0] - right[0]), 0.0), yes),
        "open": ((~bend["knee", "mid"][1] | _over(bend["knee", "mid"][0], OPEN_KNEE)) & (~bend["hip", "mid"][1] | _over(bend["hip", "mid"][0], OPEN_HIP)), yes),
        "legless": (~seen["hip", "mid"] & ~seen["knee", "mid"] & ~seen["ankle", "mid"], yes),
    }


def _parts(feature: str) -> list[str]:
    return [f"{feature}_0", f"{feature}_1"] if feature in PAIRED else [feature]


def weights(f: dict[str, Known]) -> dict[str, np.ndarray]:
    """Total weight of the cues that hold, for sitting and for standing."""
    out = {s: np.zeros(len(f["box"][0])) for s in ("sits", "stands")}
    for feature, low, high, side, weight in CUES:
        held = 0
        for v, ok in (f[x] for x in _parts(feature)):
            if low is not None:
                ok = ok & _over(v, low)
            if high is not None:
                ok = ok & ((v < float(high[1:])) if isinstance(high, str) else (v <= high))
            held = held + ok
        out[side] = out[side] + held * weight
    return out


@F.arrow_udf(returnType=FEATURES)
def _features(*batch: pa.Array) -> pa.Array:
    f = _measured(batch)
    plain = lambda n: pa.array(f[n][0], mask=~f[n][1])
    names = FEATURES.names
    return pa.StructArray.from_arrays([pa.array([[x for x in pair if x is not None] for pair in zip(*[plain(x).to_pylist() for x in _parts(n)])], pa.list_(pa.float64())) if n in PAIRED else plain(n) for n in names], names)


@F.arrow_udf(returnType=T.StructType([T.StructField("posture", T.StringType()), T.StructField("sits", T.DoubleType()), T.StructField("stands", T.DoubleType())]))
def _judged(*batch: pa.Array) -> pa.Array:
    f, speed = _measured(batch), _read(batch[-1])[0]
    w = weights(f)
    sits, stands = w["sits"], w["stands"]
    steps = _over(f["stride"][0], STRIDE, False) | (_over(f["unlike"][0], UNLIKE_KNEES, False) & _over(f["stride"][0], SHORT_STRIDE, False))
    kind = np.select([f["legless"][0] | ((sits == 0) & (stands == 0)), sits > stands, _over(speed, WALK_SPEED) & steps & f["open"][0]], [0, 1, 2], 3)
    names = pa.DictionaryArray.from_arrays(kind.astype(np.int32), ["UNKNOWN", "SITTING", "WALKING", "STANDING"]).cast(pa.string())
    return pa.StructArray.from_arrays([names, pa.array(sits), pa.array(stands)], ["posture", "sits", "stands"])


# --------------------------------------------------------------------------- expressions
def joints(keypoints: Column) -> Column:
    """x and y of both joints of every pair, null unless seen."""
    point = lambda k, c: F.when(k["conf"] > SEEN, k[c].cast("double"))
    return F.struct(*[point(keypoints[i + k], c).alias(f"{n}_{s}_{c}") for n, i in PAIRS.items() for k, s in enumerate(SIDES[:2]) for c in "xy"])


def _columns(j: Column, box: Column) -> list[Column]:
    return [*[j[f"{n}_{s}_{c}"] for n in PAIRS for s in SIDES[:2] for c in "xy"], (box[2] - box[0]).cast("double"), (box[3] - box[1]).cast("double")]


def features(j: Column, box: Column) -> Column:
    """What the cues look at, from ``joints`` and the person's box."""
    return _features(*_columns(j, box))


def posture(keypoints: Column, box: Column, speed: Column | None = None) -> Column:
    """(posture, sits, stands): SITTING, STANDING, WALKING, or UNKNOWN if no leg or hip is seen or nothing speaks for either.

    ``keypoints``: 17 structs (x, y, conf); ``box``: x1, y1, x2, y2; ``speed`` in pixels a frame.
    """
    speed = F.lit(0.0) if speed is None else F.coalesce(speed.cast("double"), F.lit(0.0))
    p = _judged(*_columns(joints(keypoints), box), speed)
    return F.struct(p["posture"].alias("posture"), F.round(p["sits"], 3).alias("sits"), F.round(p["stands"], 3).alias("stands"))
