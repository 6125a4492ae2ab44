"""DataFrame -> DataFrame operators, one module per survey stage."""
