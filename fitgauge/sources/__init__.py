"""Readers and writers: catalog views, data tables, stored results."""
