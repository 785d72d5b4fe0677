"""Keeping an index current while its source tree changes."""
