"""Imports every module that registers queries."""

from checks import experiments, labellers, log, raster, routing, streams, tiled  # noqa: F401
