"""Adapters that turn landed payloads into the common raw-article rows."""
