"""Readers and writers: Matrix Market, VCF, cell and clonotype tables, whole bundles."""
