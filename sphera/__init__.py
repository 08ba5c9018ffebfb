"""sphera: geometry on the unit sphere as Spark DataFrame plans."""
