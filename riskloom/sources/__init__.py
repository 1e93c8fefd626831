from riskloom.sources.star import Star, read_star, read_table
from riskloom.sources.driver_view import star_from_driver_tables
from riskloom.sources import sinks

__all__ = ["Star", "read_star", "read_table", "star_from_driver_tables", "sinks"]
