"""Readers and normalisers that turn raw payloads into signal rows."""
