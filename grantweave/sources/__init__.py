"""Sources: the mapping sheet, configuration relations and test inputs."""
