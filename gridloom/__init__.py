"""gridloom: power-grid analysis and data preparation as Spark jobs."""
