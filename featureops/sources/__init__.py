"""Readers and writers: raw events, contracts, the versioned feature store, metric samples."""
