"""Readers and writers: listings, station histories, station master, versioned tables, manifests."""
