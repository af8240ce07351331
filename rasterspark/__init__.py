"""Raster and acquisition analytics as plain Spark tables and DataFrame functions.

Sub-packages
------------
functions   column functions: tile and grid maths, projections, band maths, text, time, keys
operators   DataFrame -> DataFrame operators: catalog, joins, warp, pyramids, traces, images
sources     readers and writers: drop manifests, byte-range manifests, chunk reads, exports
plans       composite jobs and the resolution choice per tile
streaming   Structured Streaming ingest, metrics and rendering
registry    the checked queries and their DuckDB counterparts
"""

__version__ = "0.1.0"
