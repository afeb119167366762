"""Readers: files as bytes become cells, Markdown, HTML or text."""
