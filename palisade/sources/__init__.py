"""Readers of workspaces, logs and lockfiles."""
