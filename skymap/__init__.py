"""All-sky equal-area pixel-map analytics as PySpark DataFrame jobs."""
