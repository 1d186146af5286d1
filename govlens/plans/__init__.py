"""Whole jobs: normalization, checks, reports, detections, rollups."""
