"""Composable DataFrame operators the reports and detections are built from."""
