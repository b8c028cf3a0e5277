"""Frames ready for plotting."""
