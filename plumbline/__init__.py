"""Profile matching, track analytics and sensor-stream operators on PySpark."""
