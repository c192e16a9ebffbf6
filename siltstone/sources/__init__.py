"""Hosts: where external relations come from."""
