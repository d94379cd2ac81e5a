"""Readers and writers of runs, manifests, truth and master data, and the test-table bridge."""
