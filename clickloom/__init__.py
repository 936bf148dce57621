"""Feature preparation, profiling, history selection and evaluation as Spark jobs."""

__version__ = "0.1.0"
