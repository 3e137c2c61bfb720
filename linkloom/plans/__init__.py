"""Strategies, settings, the session and the crawl simulation."""
