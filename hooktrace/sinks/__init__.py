"""Exports, the stored threat table, and shared working folders."""
