"""Column functions: ranks, text, cells and fingerprints."""
