"""Where tables come from: the catalog, CSV files and Parquet files."""
