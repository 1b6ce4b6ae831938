"""Analysis settings: thresholds, formats and rule lists, from code or from a YAML/JSON file."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass
from datetime import datetime
from typing import Any

# Defaults that decide the results, kept equal to the published behaviour.
DEFAULT_TIMESTAMP_FORMATS = (
    "%y%m%d %H%M%S",
    "%Y-%m-%d %H:%M:%S,%f",
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%dT%H:%M:%S.%fZ",
    "%b %d %H:%M:%S",
)
DEFAULT_SUSPICIOUS_EVENTS = (
    "CreateAccessKey",
    "AttachUserPolicy",
    "AttachGroupPolicy",
    "AttachRolePolicy",
    "CreateLoginProfile",
    "UpdateAssumeRolePolicy",
    "PutUserPolicy",
)


class SettingsError(ValueError):
    """A settings file or override that cannot be used."""


@dataclass(frozen=True)
class BusinessHours:
    """Opening hours as "HH:MM"; a gap outside them is lowered to LOW."""

    start_time: str = "00:00"
    end_time: str = "23:59"
    ignore_weekends: bool = False

    @property
    def open_minute(self) -> int:
        return _minute_of_day(self.start_time)

    @property
    def close_minute(self) -> int:
        return _minute_of_day(self.end_time)


@dataclass(frozen=True)
class Settings:
    min_gap_threshold: int = 60
    max_reasonable_gap: int = 172800
    timestamp_formats: tuple[str, ...] = DEFAULT_TIMESTAMP_FORMATS
    safe_intervals: tuple[tuple[datetime, datetime], ...] = ()
    business_hours: BusinessHours | None = None
    suspicious_events: tuple[str, ...] = DEFAULT_SUSPICIOUS_EVENTS
    # Year given to stamps that carry none; None means the current one.
    default_year: int | None = None
    # Lines per block: the largest run of one log, or of one time line, that a single task orders (see operators/blocks.py).
    block_lines: int = 262_144
    # Rows per part of a text or array that grows with the findings of one log.
    part_rows: int = 10_000

    def __post_init__(self) -> None:
        for name in ("timestamp_formats", "suspicious_events"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        object.__setattr__(self, "safe_intervals", tuple(tuple(pair) for pair in self.safe_intervals))
        for name in ("block_lines", "part_rows"):
            if getattr(self, name) < 1:
                raise SettingsError(f"{name} must be at least 1")

    def override(self, **changes: Any) -> "Settings":
        """A copy with the given values; ``None`` leaves a value as it is, unknown names are an error."""
        known = {field.name for field in dataclasses.fields(self)}
        unknown = sorted(set(changes) - known)
        if unknown:
            raise SettingsError(f"unknown settings: {', '.join(unknown)}")
        return dataclasses.replace(self, **{k: v for k, v in changes.items() if v is not None})


def load_settings(path: str) -> Settings:
    """Read thresholds, formats and business hours from a ``.json``, ``.yaml`` or ``.yml`` file.

    Keys may stand at the top level, or (YAML) below one top-level section that holds nothing but settings.
    """
    if not os.path.exists(path):
        raise SettingsError(f"settings file not found: {path}")
    extension = os.path.splitext(path)[1].lower()
    with open(path, encoding="utf-8") as handle:
        if extension == ".json":
            data = json.load(handle)
        elif extension in (".yaml", ".yml"):
            try:
                import yaml
            except ImportError as error:
                raise SettingsError("YAML settings need the PyYAML package") from error
            data = _unwrap(yaml.safe_load(handle) or {})
        else:
            raise SettingsError(f"unsupported settings format: {extension}")
    return settings_from_mapping(data)


_FILE_KEYS = ("min_gap_threshold", "max_reasonable_gap", "threshold", "timestamp_formats", "business_hours")


def settings_from_mapping(data: dict[str, Any]) -> Settings:
    unknown = sorted(set(data) - set(_FILE_KEYS))
    if unknown:
        raise SettingsError(f"unknown settings: {', '.join(unknown)}")
    nested = data.get("threshold") or {}
    changes: dict[str, Any] = {
        "min_gap_threshold": data.get("min_gap_threshold", nested.get("min_gap")),
        "max_reasonable_gap": data.get("max_reasonable_gap", nested.get("max_gap")),
        "timestamp_formats": data.get("timestamp_formats"),
    }
    for name in ("min_gap_threshold", "max_reasonable_gap"):
        if changes[name] is not None:
            changes[name] = int(changes[name])
    hours = data.get("business_hours")
    if hours is not None:
        changes["business_hours"] = BusinessHours(
            start_time=hours.get("start", "09:00"),
            end_time=hours.get("end", "17:00"),
            ignore_weekends=bool(hours.get("ignore_weekends", False)),
        )
    return Settings().override(**changes)


def _unwrap(data: dict[str, Any]) -> dict[str, Any]:
    if len(data) == 1:
        (key, value), = data.items()
        if key not in _FILE_KEYS and isinstance(value, dict):
            return value
    return data


def _minute_of_day(text: str) -> int:
    hour, minute = (int(part) for part in text.split(":"))
    if not (0 <= hour < 24 and 0 <= minute < 60):
        raise SettingsError(f"not a time of day: {text!r}")
    return hour * 60 + minute
