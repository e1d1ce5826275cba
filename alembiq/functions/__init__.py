"""Column functions: null-aware means, rules, ADMET classes, similarity kernels, units and geometry."""
