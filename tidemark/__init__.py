"""Integrity analysis of ordered logs on Spark."""

from tidemark.plans.analyze import Findings, analyze
from tidemark.settings import BusinessHours, Settings, SettingsError, load_settings
from tidemark.streaming.follow import follow_appended, follow_text, messages
from tidemark.streaming.incremental import analyze_stream, findings_so_far
from tidemark.workspace import Workspace

__all__ = [
    "BusinessHours", "Findings", "Settings", "SettingsError", "Workspace", "analyze", "analyze_stream", "findings_so_far",
    "follow_appended", "follow_text", "load_settings", "messages",
]
