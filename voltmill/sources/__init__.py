"""Readers and writers of recordings, probes and sortings."""
