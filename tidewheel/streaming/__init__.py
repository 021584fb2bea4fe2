"""The same metrics on growing inputs."""
