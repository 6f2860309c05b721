"""Where rows come from and go to: Parquet tables, verified when read, and synthetic tables."""
