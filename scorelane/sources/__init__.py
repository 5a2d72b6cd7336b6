"""Readers for response sets, result documents, prediction maps and catalogues."""
