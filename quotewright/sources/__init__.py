"""Scans, sinks, vendor adapters, fingerprints and manifests."""
