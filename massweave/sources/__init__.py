"""Readers of spectra and projects, writers of tables and reports."""
