"""Column functions: classification, conversion, cleaning."""
