"""blockloom: block correlation and structural diff over DataFrames of text pairs."""

__version__ = "0.1.0"
