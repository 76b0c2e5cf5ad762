"""Readers: dumps, device-name payloads, vendor files, tables and replay buffers."""
