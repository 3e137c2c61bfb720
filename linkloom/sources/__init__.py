"""Readers and writers: seeds, robots rules, sitemaps, page links, event logs, the store."""
