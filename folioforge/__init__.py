"""folioforge: tables of captured web responses in, clean document bundles out, on Spark."""

__version__ = "0.1.0"
