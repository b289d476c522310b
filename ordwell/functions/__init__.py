"""Ordwell subpackage."""
