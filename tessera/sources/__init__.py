from tessera.sources.tables import SCHEMAS, TABLES, load_table, load_tables
from tessera.sources.files import read_delimited, read_json_lines, write_partitioned

__all__ = ["SCHEMAS", "TABLES", "load_table", "load_tables", "read_delimited",
           "read_json_lines", "write_partitioned"]
