"""Relational operators on event trains, signals, probes and templates."""
