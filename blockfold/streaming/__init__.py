"""Structured Streaming jobs: subscriptions and the upkeep of derived tables."""
