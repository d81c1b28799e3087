"""Operators over text, code, telemetry and inventories."""
