"""Readers and writers for ring files, catalogues, tables and grids."""
