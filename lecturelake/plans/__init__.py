"""Queries over the driver's tables: inputs in the roles of the engine's tables, the operators, and SQL for comparison."""
