"""Plan-level helpers: lineage cuts and the semi-naive closure loop."""
