"""Progress of scans as streams."""
