from .files import container_listing, directory_listing, from_rows, latest_snapshot, list_files, read_csv, read_parquet, read_snapshot, read_tables, scratch_folder
from .jdbc import Parts, read_jdbc, schema_exists, write_jdbc

__all__ = ["Parts", "container_listing", "directory_listing", "from_rows", "latest_snapshot", "list_files", "read_csv", "read_parquet", "read_snapshot", "read_tables", "read_jdbc", "schema_exists", "scratch_folder", "write_jdbc"]
