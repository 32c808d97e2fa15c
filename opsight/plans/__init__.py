"""How the operators are wired together: the set of tables and the rule book."""
