"""Outputs: partitioned tables, raw backups, rejects and exports."""
