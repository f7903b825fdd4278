"""Declared tables: their columns, dates and keys."""
