"""Column-level helpers: name resolution, contracts, scalar expressions, hashing."""
