"""Column expressions; none needs Python on the executors unless its docstring says so."""
