"""Readers and writers for catalogs, probes, layers, subtitles, plans and reports."""
