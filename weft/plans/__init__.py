"""Plan-level helpers: lineage control, superstep loops, scans."""
