"""Column functions: text metrics, repair rules, geometry and image kernels."""
