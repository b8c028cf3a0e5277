"""Operators over cubes of allele counts."""
