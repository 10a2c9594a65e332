"""Thresholds of the temporal operators, in seconds and shares; one place for batch and streams."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    enter_confirm_s: float = 0.7
    exit_confirm_s: float = 1.0
    lost_grace_s: float = 5.0
    lost_ttl_s: float = 8.0
    gap_tolerance_s: float = 0.5
    forget_after_s: float = 60.0
    evidence_wait_s: float = 4.0
    ppe_grace_s: float = 3.0
    dwell_warn_fraction: float = 0.8
    realert_after_s: float = 60.0
    exit_slack_s: float = 1.5
    support_floor: float = 0.6
    ppe_presence_fraction: float = 0.6
    still_speed: float = 0.15
    man_down_angle: float = 60.0
    man_down_upright: float = 45.0
    man_down_s: float = 5.0
    clear_fraction: float = 0.6
    recover_s: float = 1.0
    lost_s: float = 1.5
    motion_window_s: float = 0.6
    occupancy_grace_s: float = 10.0
    occupancy_window_s: float = 2.0
    occupancy_clear: float = 0.6
    occupancy_samples: int = 3
    sample_every_s: float = 5.0
    upright_aspect: float = 0.9
    lying_aspect: float = 1.1
    down_aspect: float = 1.2


PAIRS = (("lost_grace_s", "lost_ttl_s"), ("man_down_upright", "man_down_angle"))


def load(values: dict[str, str], prefix: str = "SAFETY_") -> tuple[Config, list[str]]:
    """A configuration from text values and what was wrong with them; a bad value, and both of a pair out of order, keep their defaults."""
    base, given, wrong = Config(), {}, []
    for f in fields(Config):
        raw = values.get(prefix + f.name.upper())
        if raw is None:
            continue
        try:
            v = type(getattr(base, f.name))(raw)
            if not 0 <= v < float("inf"):
                raise ValueError
            given[f.name] = v
        except ValueError:
            wrong.append(f"{f.name}: {raw!r} is not a number of 0 or more")
    for low, high in PAIRS:
        if given.get(low, getattr(base, low)) > given.get(high, getattr(base, high)):
            wrong.append(f"{low} must not exceed {high}")
            given.pop(low, None)
            given.pop(high, None)
    return Config(**given), wrong
