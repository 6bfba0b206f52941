"""Scans that run as files arrive."""
