"""Writers for parquet tables and ledgers."""
