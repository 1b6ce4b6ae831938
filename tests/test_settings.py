import json

import pytest

from tidemark import BusinessHours, Settings, SettingsError, load_settings


def test_nested_yaml(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "settings.yaml"
    path.write_text(
        "logs:\n  threshold:\n    min_gap: 120\n    max_gap: 300000\n  business_hours:\n    start: \"08:00\"\n"
        "    end: \"18:00\"\n    timezone: \"UTC\"\n    ignore_weekends: true\n"
    )
    settings = load_settings(str(path))
    assert settings.min_gap_threshold == 120
    assert settings.max_reasonable_gap == 300000
    assert settings.business_hours == BusinessHours("08:00", "18:00", True)


def test_flat_json_and_formats(tmp_path):
    path = tmp_path / "settings.json"
    path.write_text(json.dumps({"min_gap_threshold": 90, "timestamp_formats": ["%H:%M:%S"], "business_hours": {}}))
    settings = load_settings(str(path))
    assert settings.min_gap_threshold == 90
    assert settings.timestamp_formats == ("%H:%M:%S",)
    assert settings.business_hours == BusinessHours("09:00", "17:00", False)


def test_overrides():
    settings = Settings().override(min_gap_threshold=300, max_reasonable_gap=None)
    assert (settings.min_gap_threshold, settings.max_reasonable_gap) == (300, 172800)
    with pytest.raises(SettingsError):
        Settings().override(no_such_setting=1)


def test_bad_files(tmp_path):
    with pytest.raises(SettingsError):
        load_settings(str(tmp_path / "absent.json"))
    odd = tmp_path / "settings.ini"
    odd.write_text("")
    with pytest.raises(SettingsError):
        load_settings(str(odd))
    unknown = tmp_path / "settings.json"
    unknown.write_text('{"min_gap": 3}')
    with pytest.raises(SettingsError):
        load_settings(str(unknown))
