"""Readers for file inventories, tool output, item documents and run folders."""
