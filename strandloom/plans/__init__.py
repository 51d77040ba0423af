"""Plan helpers: orders, intervals, written tables and the derived inputs of the registered queries."""
