"""Blockfold: a PySpark engine for append-only, irreversible block histories."""
