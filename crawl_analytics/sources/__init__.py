"""Readers and writers of the raw lake, the result tree and the side inputs."""
