"""Composed views (dashboards, map, quality) and the registered query catalog."""
