"""Jobs and reports made of operators, and the registered queries."""
