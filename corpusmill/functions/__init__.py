"""Column functions: everything here stays inside the JVM unless a docstring says otherwise."""
