"""Outputs as files, and the folder that driver and executors share."""
