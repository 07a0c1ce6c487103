"""Document evidence analytics as DataFrame-to-DataFrame operators on PySpark."""
