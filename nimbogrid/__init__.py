"""nimbogrid: gridded-field, ensemble and observation analytics on PySpark."""

__version__ = "0.1.0"
