"""Writers: keyed tables, page snapshots, JSON."""
