"""Column builders. Everything here returns a ``Column`` and runs inside the JVM."""
