"""The driver's tables in the roles of entities, events and items, and the registered queries."""
