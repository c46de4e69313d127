"""Scalar functions as column expressions: names, assets, time slots and codecs."""
