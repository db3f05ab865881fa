"""Readers, table writers and table maintenance."""
