from .tables import TABLES, read_table, Tables

__all__ = ["TABLES", "read_table", "Tables"]
