"""Feeds in, events out: landed provider records and the event store."""
