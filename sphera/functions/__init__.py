"""Column functions: points, angles, cells, intervals, rectangles, caps and edges."""
