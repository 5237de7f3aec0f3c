"""Where rows come from and go: the versioned store, registered Parquet files, scratch folders."""
