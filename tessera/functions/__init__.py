"""Column functions: grid arithmetic, pixel algebra, seam costs, scene names."""
