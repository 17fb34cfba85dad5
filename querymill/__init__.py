"""querymill: query suggestion, ranking data and site trust analytics as Spark plans."""

__version__ = "0.1.0"
