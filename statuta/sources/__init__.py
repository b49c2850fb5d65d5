"""Readers: landed files, packages, intermediate JSON, pages; and the domain views."""
