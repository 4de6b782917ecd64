"""The repair planner and the registered queries."""
