"""Structured Streaming jobs over the same normalizers and detections."""
