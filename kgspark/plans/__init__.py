"""Queries of the driver surface and the SQL they are compared with."""
