"""Pixel-table, mask-table and decision-log analytics as Spark DataFrame operators."""
