"""Operators on fragments, regions, cell-by-feature matrices, neighbours, clusters and networks."""
