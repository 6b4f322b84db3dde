"""Building analytics from point clouds and footprints, and corpus operators, on PySpark."""

from .recon.build import BuildParameters, Mesh, reconstruct, triangulate_mesh

__all__ = ["BuildParameters", "Mesh", "reconstruct", "triangulate_mesh"]
