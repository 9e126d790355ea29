"""Readers and writers for snapshots, quarantine logs, stations and raw payloads."""
