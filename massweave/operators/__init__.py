"""Relational operators over peaks, scans and aligned tables."""
