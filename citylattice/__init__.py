"""citylattice: urban voxel models, simulations and exports as Spark plans."""
