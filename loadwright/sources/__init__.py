"""Reading snapshots, writing staging tables and key maps, intermediate results."""
