"""Spatial segment analytics on Spark: voxels, segments, descriptors, matches, recognition, maps."""
