"""Composed jobs: feature build, training, evaluation, reports, and the
mapping of the driver's test tables onto the race-shaped inputs."""
