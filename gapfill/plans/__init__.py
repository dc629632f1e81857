"""Work that strings operators together: full evaluation and experiment grids."""
