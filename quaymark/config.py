"""Parameters of a build, and a file of them."""

from __future__ import annotations

import datetime as dt
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class EngineConfig:
    """as_of is the day the engine runs: what became available on or before it is visible."""

    as_of: dt.date = dt.date(2001, 8, 2)
    vat_rate: float = 0.20
    recon_tolerance_pct: float = 2.0
    horizons: tuple[int, ...] = (30, 60, 90)
    channels: tuple[str, ...] = ("meta", "google", "tiktok", "unattributed")
    fdr_alpha: float = 0.10


#: Tables of a settings file besides [engine], and the field of Thresholds that each of their keys sets. A detector's table also has `enabled`.
SECTIONS = {
    "trend": {"window_days": "evidence_days", "min_points": "min_points"},
    "detectors.cac_ltv_breach": {"horizon_days": "horizon", "breach_ratio": "breach_ratio", "persistence_days": "breach_days", "min_new_customers": "breach_customers"},
    "detectors.cac_trend": {"window_days": "trend_days", "min_pct_per_day": "cac_pct_per_day", "max_p_value": "max_p"},
    "detectors.cpc_decomposition": {"min_cpc_change_pct": "cpc_pct", "dominance_ratio": "dominance"},
    "detectors.product_velocity": {"z_threshold": "velocity_z", "min_units_28d": "velocity_units", "warmup_days": "warmup_days", "min_history": "history"},
    "detectors.inventory_cover": {"critical_days": "cover_critical", "warning_days": "cover_warning"},
    "detectors.aov_decomposition": {"min_change_pct": "aov_pct", "max_p_value": "max_p"},
    "detectors.email_engagement_decay": {"min_open_rate_decline_pct": "open_decline_pct", "comovement_ratio": "comovement", "min_weeks": "email_weeks", "skip_weeks": "email_warmup"},
    "detectors.cohort_retention_shift": {"min_cohort_size": "cohort_size", "min_decline_pct": "cohort_decline_pct", "min_cohorts": "cohorts"},
    "detectors.channel_cvr_shift": {"window_days": "trend_days", "min_clicks": "cvr_clicks", "min_change_pct": "cvr_pct", "max_p_value": "max_p"},
    "detectors.data_completeness": {"suppression_window_days": "suppression_days"},
}


@dataclass(frozen=True)
class Settings:
    engine: EngineConfig
    thresholds: object
    #: (detector, action, whether it can be undone)
    actions: tuple[tuple[str, str, bool], ...]


def _typed(cls, given: dict, where: str) -> dict:
    """given values as the fields of a dataclass have them; a key that is no field, or a value of another kind, is an error."""
    defaults = {f.name: f.default for f in fields(cls)}
    out = {}
    for name, value in given.items():
        if name not in defaults:
            raise ValueError(f"{where}: no setting {name}")
        value = tuple(value) if isinstance(value, list) else value
        kind = type(defaults[name])
        if kind is float and type(value) is int:
            value = float(value)
        if type(value) is not kind:
            raise ValueError(f"{where}: {name} is a {kind.__name__}, not {value!r}")
        out[name] = value
    return out


def load_settings(path: str | Path) -> Settings:
    """A TOML file with [engine], [fdr] alpha, [trend], [detectors.<name>] and [actions.<name>] (type, reversible).

    What is left out keeps its default. Unknown tables and keys, values of another kind, and two tables that set one threshold
    to different values are errors, so a misspelt threshold is never silently the default.
    """
    from .operators.recommend import ACTIONS
    from .operators.signals import Thresholds

    with open(path, "rb") as f:
        given = tomllib.load(f)
    flat = {k: v for k, v in given.items() if k not in ("detectors", "actions")}
    flat |= {f"detectors.{k}": v for k, v in given.get("detectors", {}).items()}
    engine, thresholds, off = dict(flat.pop("engine", {})), {}, []
    fdr = flat.pop("fdr", {})
    if set(fdr) - {"alpha"}:
        raise ValueError(f"[fdr]: no setting {sorted(set(fdr) - {'alpha'})[0]}")
    engine |= {"fdr_alpha": v for v in fdr.values()}
    for section, values in flat.items():
        if section not in SECTIONS:
            raise ValueError(f"no table [{section}]")
        values = dict(values)
        if section.startswith("detectors.") and not values.pop("enabled", True):
            off.append(section.removeprefix("detectors."))
        for key, value in values.items():
            name = SECTIONS[section].get(key)
            if not name:
                raise ValueError(f"[{section}]: no setting {key}")
            if thresholds.setdefault(name, value) != value:
                raise ValueError(f"[{section}]: {key} differs from what another table says")
    acts = {d: (a, r) for d, a, r in ACTIONS}
    for detector, values in given.get("actions", {}).items():
        if detector not in acts or set(values) - {"type", "reversible"}:
            raise ValueError(f"[actions.{detector}]: unknown")
        acts[detector] = (values.get("type", acts[detector][0]), values.get("reversible", acts[detector][1]))
    return Settings(
        EngineConfig(**_typed(EngineConfig, engine, "[engine]")), Thresholds(**_typed(Thresholds, thresholds | {"disabled": tuple(off)}, "thresholds")), tuple((d, a, r) for d, (a, r) in acts.items()))
