"""Folder of the tables that the tests read."""

SF_DIR = "/root/testdata/sf0.001"
