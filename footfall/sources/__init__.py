"""Inputs: access logs, stored tables and object notifications."""
