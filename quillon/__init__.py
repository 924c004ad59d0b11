"""quillon: text analytics over document corpora, expressed as lazy Spark plans."""

__version__ = "0.1.0"
