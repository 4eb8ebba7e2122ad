"""Readers that turn files and payload tables into the record schemas."""
