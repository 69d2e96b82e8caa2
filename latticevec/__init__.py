"""latticevec: batch nearest-neighbour analytics over dense vectors, expressed as Spark plans."""

__version__ = "0.1.0"
