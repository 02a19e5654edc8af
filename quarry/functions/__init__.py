"""Column-level functions: cleaners, label maps, bias-corrected moments, p-values."""
