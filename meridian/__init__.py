"""Link-graph and spherical analytics as DataFrame operators."""
