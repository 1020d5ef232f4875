"""Readers that turn repositories and tables into fact inputs."""
