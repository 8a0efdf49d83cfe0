"""Readers and writers for recordings, reference series, reports and result tables."""
