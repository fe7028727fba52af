from .hashing import SEED, hash_hex, hash_int, hash_unit, hash_hex_sql, hash_unit_sql
from .safe import safe_div, round_half_even, nan_to_null

__all__ = ["SEED", "hash_hex", "hash_int", "hash_unit", "hash_hex_sql", "hash_unit_sql",
           "safe_div", "round_half_even", "nan_to_null"]
