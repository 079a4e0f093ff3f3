"""tandem: coordinated-behaviour networks over message data, as lazy Spark plans."""

__version__ = "0.1.0"
