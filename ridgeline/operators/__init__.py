"""Operators on panels of bars: features, calendars, membership, labels, data quality."""
