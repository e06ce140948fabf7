"""Reports that set exact and approximate plans side by side, and the query catalogue."""
