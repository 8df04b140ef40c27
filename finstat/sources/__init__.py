from finstat.sources.buckets import load_buckets, save_buckets
from finstat.sources.ledger import Ledger, from_files, from_parquet, from_tables, ledger, load_ledger, register_views, save_ledger, unsalted

__all__ = [
    "Ledger",
    "from_files",
    "from_parquet",
    "from_tables",
    "ledger",
    "load_buckets",
    "load_ledger",
    "register_views",
    "save_buckets",
    "save_ledger",
    "unsalted",
]
